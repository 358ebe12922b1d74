"""Lexical retrieval packing with a sharded BM25 inverted index.

The document frequencies of all token ids, a vector as long as the vocabulary, are counted over all documents. A
document's key is its rarest shared ids: ids are ranked once, by a hash that rarity weighs (weighted MinHash), and the key
is the least four ranks among the document's ids. Documents are dealt by the first rank and sorted by the key, so that
those with many rare ids in common tend to meet; adaptive execution splits what one rank overfills. A task takes its
documents in shards of at most SHARD_TOKENS ids. Each shard builds its own inverted index over token ids. A seed document
opens a window; its unused neighbours, best BM25 score first and ties in the shard's order, fill the window, and the one
that reaches the end is cut there. Its rest is the next seed, so nothing is padded; what a shard has left for its last
window is cut into sequences whose lengths are powers of two. Neighbours outside a seed's shard are not seen.

Memory: one shard and one chunk of texts. Rows: one per piece. Null text counts as empty and is the end id alone. Null
doc_id: packed like any document. Rows that repeat a doc_id are documents of their own. More columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save
from .textvec import mix
from .tokens import END_ID, WORD_BPE, encoder

WINDOW = 2048
SHARD_TOKENS = 1 << 20
KEYS, RARITY = 4, 2.0  # ids in a key, and the power of the inverse document frequency that weighs an id
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 over one shard: postings by term, impacts computed once. Terms in half the documents or more weigh nothing."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        length = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), length)
        flat.sort()
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))  # by term, then document
        pair, tf = flat[first], np.diff(np.append(first, len(flat)))
        del flat, first
        self.doc, term = (pair % n).astype(np.int32), (pair // n).astype(np.int32)
        edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]]))
        df = np.diff(edge)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1))
        self.impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        used = np.flatnonzero(idf > 0)
        self.lo, self.hi = edge[:-1][used], edge[1:][used]
        # the terms of each document, as positions in lo and hi
        at = np.repeat(np.arange(len(df), dtype=np.int32), df)
        place = np.full(len(df), -1, np.int32)
        place[used] = np.arange(len(used))
        keep = place[at] >= 0
        order = np.argsort(self.doc[keep], kind="stable")
        self.terms = place[at][keep][order]
        self.of = np.searchsorted(self.doc[keep][order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the seed's distinct terms."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        lo, size = self.lo[terms], self.hi[terms] - self.lo[terms]
        if not len(terms):
            return np.zeros(self.n)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    index = Index(docs)
    left = np.ones(index.n, bool)
    sequence, used, waiting, seed, first = 0, 0, [], 0, 0
    last: list[tuple[int, int, int, int]] = []  # the pieces of the open window
    start = 0  # of the seed, its ids already placed
    while True:
        if seed < 0:
            while first < index.n and not left[first]:
                first += 1
            if first == index.n:
                break
            seed, start = first, 0
        left[seed] = False
        waiting = [(seed, start)]
        ranked: np.ndarray | None = None
        at = 0
        last, used = [], 0
        rest = (-1, 0)
        while used < window:
            if not waiting:
                if ranked is None:
                    open_ = np.flatnonzero(left)
                    score = index.scores(seed)[open_] if len(open_) else np.zeros(0)
                    ranked = open_[np.argsort(-score, kind="stable")]
                if at == len(ranked):
                    break
                waiting = [(int(ranked[at]), 0)]
                left[ranked[at]] = False
                at += 1
            doc, begin = waiting.pop()
            n = min(window - used, len(docs[doc]) - begin)
            last.append((doc, begin, n, used))
            used += n
            if begin + n < len(docs[doc]):
                rest = (doc, begin + n)
        if used == window:
            for doc, begin, n, offset in last:
                yield doc, begin, n, sequence, offset
            sequence += 1
        else:  # the shard's last window
            parts = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
            room, offset = parts[0], 0
            for doc, begin, n, _ in last:
                while n:
                    if not room:
                        parts.pop(0)
                        sequence += 1
                        room, offset = parts[0], 0
                    m = min(n, room)
                    yield doc, begin, m, sequence, offset
                    begin, n, room, offset = begin + m, n - m, room - m, offset + m
            break
        seed, start = rest


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            names = batch.column(0).cast(pa.int64())
            for i, ids, off in own.columns(batch.column(1), end_id):
                edges = pa.py_buffer((off * own.kind.itemsize).astype(np.int32).tobytes())
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([names.slice(i, n), pa.BinaryArray.from_buffers(pa.binary(), n, [None, edges, pa.py_buffer(ids.tobytes())])], names=["doc_id", "ids"])

    return run


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a binary column."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind), (off - off[0]) // kind.itemsize


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        size = own.tokenizer.get_vocab_size()
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, off = _flat(batch.column(0), own.kind)
            for a in range(0, len(off) - 1, 256):
                part = off[a : a + 257]
                doc = np.repeat(np.arange(len(part) - 1), np.diff(part))
                pair = np.sort(doc * size + ids[part[0] : part[-1]])
                total += np.bincount(pair[np.concatenate([[True], pair[1:] != pair[:-1]])] % size, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "df"])

    return run


def ranks(df: np.ndarray, n: int) -> np.ndarray:
    """The rank of each id; ids in one document only, or in half of them or more, come last, the others rarest likeliest first."""
    uniform = (mix(np.arange(1, len(df) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53
    weight = np.where(df > 1, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0), 0.0) ** RARITY
    with np.errstate(divide="ignore"):
        value = -np.log1p(-uniform) / weight
    out = np.empty(len(df), np.int32)
    out[np.lexsort((np.arange(len(df)), value))] = np.arange(len(df))
    return out


def keys(ids: np.ndarray, off: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The least KEYS distinct ranks of each document, a column each; where there are fewer, the number of ranks."""
    own = rank[ids].astype(np.int64)
    out = np.full((len(off) - 1, KEYS), len(rank), np.int64)
    for j in range(KEYS):
        out[:, j] = np.minimum.reduceat(own, off[:-1])  # a document has its end id at least
        own[own == np.repeat(out[:, j], np.diff(off))] = len(rank)
    return out


def _keyed(path: str, rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        for batch in batches:
            if batch.num_rows:
                key = keys(*_flat(batch.column(1), kind), rank.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key[:, 0], pa.int32()), pa.array(list(key[:, 1:].astype(np.int32)), pa.list_(pa.int32())), batch.column(1)], names=["doc_id", "key", "more", "ids"])

    return run


def _packer(path: str, window: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).kind
        base = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal base, held
            rows = [(names[d], a, n, zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()), len(ids[d]), base + s, o) for d, a, n, s, o in pack_shard(ids, window)]
            base = max(r[5] for r in rows) + 1
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_py(), kind)
                if ids and held + len(own) > shard_tokens:
                    yield packed()
                ids.append(own)
                names.append(name.as_py())
                held += len(own)
        if ids:
            yield packed()

    return run


def pack(docs: DataFrame, path: str = WORD_BPE, end_id: int = END_ID, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence; see the module's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = save(rows.mapInArrow(_tokenise(path, end_id), "doc_id long, ids binary"), "ids")
    found = ids.select("ids").mapInArrow(_frequencies(path), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()  # a row for each id of the vocabulary at most
    df = np.zeros(encoder(path).tokenizer.get_vocab_size(), np.int64)
    for r in found:
        df[r["id"]] = r["df"]
    rank = docs.sparkSession.sparkContext.broadcast(ranks(df, int(df[end_id])))  # each document has the end id
    near = ids.mapInArrow(_keyed(path, rank), "doc_id long, key int, more array<int>, ids binary").hint("rebalance", "key").sortWithinPartitions("key", "more", "doc_id", "ids")
    return near.select("doc_id", "ids").mapInArrow(_packer(path, window, shard_tokens), PIECES)
