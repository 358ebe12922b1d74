"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its unary score is linear in features of the line and of its two neighbours; a 2 x 2 table
scores neighbouring states. A document's score is the mean of its lines' forward-backward marginals for "good",
weighted by their lengths.

Training: the lines of a labelled document take its label; the conditional likelihood is maximised on a sample of at
most `max_docs` labelled documents (the first by a hash of the id), whose lines' features, not texts, come to the
driver. Chains are cut into pieces of PIECE lines for training only; scoring runs over whole documents.

Rows: one per input row. Null or empty text is one empty line and has a score. Null doc_id: scored like any row,
held_out null. Without labels of both kinds the score is their share of good ones (0.5 without any). Labels that
disagree about a document count as bad. More columns of the input are ignored; no column but the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import mix, text_chunks, word_hashes, word_starts

THRESHOLD = 0.3
MAX_DOCS = 2000
FOLDS = 5
PIECE = 64
STEPS, RATE, L2 = 150, 0.08, 1e-3


#: Disjoint classes of bytes whose shares are features; bytes of 128 and more are the last class, all others none.
_SETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "#$%&*+=@^_~\\<>", "(){}[]/", ":;-'\"")
N_CLASSES = len(_SETS) + 1
CLASS = np.full(256, N_CLASSES, np.int64)
CLASS[128:] = N_CLASSES - 1
for _k, _chars in enumerate(_SETS):
    CLASS[[ord(c) for c in _chars]] = _k
N_LOCAL = N_CLASSES + 10


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, line offsets of the texts); a text has one line more than line breaks."""
    breaks = np.flatnonzero(data == 10)
    n_lines = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    loff = np.concatenate([[0], np.cumsum(n_lines)])
    # starts of all lines, texts in order; each text starts with a line at its offset
    start = np.empty(loff[-1], np.int64)
    first = np.zeros(loff[-1], bool)
    first[loff[:-1]] = True
    start[first] = off[:-1]
    start[~first] = breaks + 1
    end = np.append(start[1:], len(data))
    end[:-1] -= ~first[1:]  # the line break itself
    size = end - start

    words, _ = word_hashes(data, off)
    starts, space, _ = word_starts(data, off)
    length = np.add.reduceat((~space[starts[0] :]).astype(np.int64), starts - starts[0]) if len(starts) else np.zeros(0, np.int64)
    wa, wb = np.searchsorted(starts, start), np.searchsorted(starts, end)
    n_words = wb - wa

    def of_words(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return run[wb] - run[wa]

    line_of = np.repeat(np.arange(len(start)), n_words)
    with np.errstate(over="ignore"):
        pair = mix(words + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(pair, return_index=True)
        new = np.zeros(len(words))
        new[at] = 1.0  # the first of its kind on its line
        step = np.cumprod(np.full(len(words) + 1, np.uint64(0xD6E8FEB86659FD93)))
        inverse = np.cumprod(np.full(len(words) + 1, np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * step[:-1])])
        doc_of = np.repeat(np.arange(len(n_lines)), n_lines)
        whole = mix((run[wb] - run[wa]) * inverse[wa] + doc_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, at = np.unique(whole, return_index=True)
    repeated = np.ones(len(start))
    repeated[at] = 0.0  # the line came before in its text
    repeated[n_words == 0] = 0.0
    some, by, per = np.maximum(n_words, 1), np.maximum(size, 1), np.minimum(size, 1)
    last = np.zeros(len(start))
    full = n_words > 0
    if len(starts):
        tail = data[starts[wb[full] - 1] + length[wb[full] - 1] - 1]
        last[full] = (tail == 46) | (tail == 33) | (tail == 63)
    first_upper = (CLASS[data[np.minimum(start, len(data) - 1)]] == 0) * per if len(data) else per
    kinds = np.repeat(np.arange(len(start)) * (N_CLASSES + 1), np.diff(np.append(start, len(data)))) + CLASS[data]
    shares = np.bincount(kinds, minlength=len(start) * (N_CLASSES + 1)).reshape(len(start), -1)[:, :N_CLASSES] / by[:, None]
    columns = [np.log1p(n_words), np.log1p(size), of_words(length) / some / 10, of_words(length <= 3) / some, of_words(length > 12) / some, of_words(new) / some, repeated, last, first_upper, (n_words == 0).astype(float)]
    return np.concatenate([shares, np.stack(columns, axis=1)], axis=1), size, loff


def with_neighbours(local: np.ndarray, loff: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after; zeros beyond a text."""
    before, after = np.zeros_like(local), np.zeros_like(local)
    before[1:], after[:-1] = local[:-1], local[1:]
    before[loff[:-1]] = 0
    after[loff[1:] - 1] = 0
    return np.concatenate([local, before, after], axis=1)


def marginals(unary: np.ndarray, loff: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transition counts, log partition) of chains given by offsets.

    unary: score of good, bad being 0; trans[a, b]: score of state b after a. Chains run side by side, longest first.
    """
    n = np.diff(loff)
    order = np.argsort(-n, kind="stable")
    n, base = n[order], loff[:-1][order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, steps + 1), "right")  # chains that have a line t
    good = np.zeros(len(unary))
    fwd = np.zeros((len(unary), 2))
    alpha = np.zeros((len(n), 2))
    for t in range(steps):
        k = live[t]
        at = base[:k] + t
        if t:
            alpha = np.logaddexp(alpha[:k, :1] + trans[0], alpha[:k, 1:] + trans[1])
        else:
            alpha = np.zeros((k, 2))
        alpha[:, 1] += unary[at]
        fwd[at] = alpha
    log_z = np.logaddexp(fwd[base + n - 1, 0], fwd[base + n - 1, 1])
    beta = np.zeros((len(n), 2))
    pair = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = base[:k] + t
        good[at] = np.exp(fwd[at, 1] + beta[:k, 1] - log_z[:k])
        if t:
            emit = beta[:k].copy()
            emit[:, 1] += unary[at]
            joint = fwd[at - 1][:, :, None] + trans[None] + emit[:, None, :]
            pair += np.exp(joint - log_z[:k, None, None]).sum(axis=0)
            beta[:k] = np.logaddexp(trans[:, 0] + emit[:, :1], trans[:, 1] + emit[:, 1:])
    return good, pair, float(log_z.sum())


class Model:
    """Weights of standardised features, a bias and the transition table."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, trans: np.ndarray, constant: float | None = None):
        self.mean, self.scale, self.weight, self.bias, self.trans, self.constant = mean, scale, weight, bias, trans, constant

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One score for each text of a chunk."""
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        local, size, loff = line_features(data, off)
        x = (with_neighbours(local, loff) - self.mean) / self.scale
        good, _, _ = marginals(x @ self.weight + self.bias, loff, self.trans)
        weight = np.maximum(size, 1).astype(float)
        return np.clip(np.add.reduceat(good * weight, loff[:-1]) / np.add.reduceat(weight, loff[:-1]), 0.0, 1.0)


def fit(chains: list[tuple[int, np.ndarray]]) -> Model:
    """Maximise the conditional likelihood of the labels by Adam; chains: (label, features with neighbours)."""
    width = 3 * N_LOCAL
    labels = np.array([y for y, _ in chains], float)
    if not len(chains) or labels.min() == labels.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), float(labels.mean()) if len(chains) else 0.5)
    pieces = [(y, f[i : i + PIECE]) for y, f in chains for i in range(0, len(f), PIECE)]
    x = np.concatenate([f for _, f in pieces])
    loff = np.concatenate([[0], np.cumsum([len(f) for _, f in pieces])])
    y = np.repeat([float(v) for v, _ in pieces], np.diff(loff))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = (x - mean) / scale
    # a document weighs the same however many lines it has, and both labels weigh the same in all
    moves = np.maximum(np.diff(loff) - 1, 0)
    per = np.array([v for v, _ in pieces])
    seen = np.array([[moves[per == 0].sum(), 0], [0, moves[per == 1].sum()]], float)
    theta = np.zeros(width + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pair, _ = marginals(x @ theta[:width] + theta[width], loff, theta[width + 1 :].reshape(2, 2))
        d = (y - good) / len(y)
        grad = np.concatenate([x.T @ d, [d.sum()], ((seen - pair) / len(y)).ravel()]) - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, data, off in text_chunks(batch.column(1)):
            local, _, loff = line_features(data, off)
            every = with_neighbours(local, loff).astype(np.float32)
            found += [every[a:b].tobytes() for a, b in zip(loff[:-1], loff[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most max_docs labelled documents whose fold is not 0."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))
    sample = known.where(fold(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_label", "_text")
    found = rows.dropDuplicates(["_id"]).select("_label", "_text", "_id")
    kept = found.select("_label", "_text").mapInArrow(_featured, "label int, features binary").collect()
    kept.sort(key=lambda r: (r["label"], bytes(r["features"])))
    return fit([(r["label"], np.frombuffer(r["features"], np.float32).reshape(-1, 3 * N_LOCAL).astype(float)) for r in kept])


def quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; see the module's text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_docs, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.scores(data, off) for _, data, off in text_chunks(batch.column(2))]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.scores(data, off) >= threshold for _, data, off in text_chunks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(good, docs.schema)
