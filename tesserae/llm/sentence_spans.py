"""Substring dedup by spans of words that start where the words say so.

`dedup_passages` is what the queries run. It finds every run of at least WINDOW + WORDS words that two places share, at
any word position, and every shared run of at least WORDS words that starts with a sentence. WORDS words from an anchor
are hashed. Anchors are the words after one that ends in . ! or ?, the first words of texts and lines, and, in each
stretch of WINDOW words without the former, the one whose next WORDS words have the least hash. So anchors move with the
text. Two anchors of a run are at most WINDOW words apart, so what a place shares with the first occurrence beyond an
anchor's words is found by comparing WINDOW words on either side. The first occurrence, by doc_id, text and place, stays,
and the words any other one shares with it are cut. Within one text a cut starts behind the first occurrence's words.

`dedup_spans` compares whole sentences only: a sentence ends after a word that ends in . ! or ?, at a line break, and
after MAX_WORDS words. From each sentence the shortest run of at least SENTENCES sentences and WORDS words is hashed,
forwards and backwards, and the sentences covered by any occurrence but the first are cut out of their texts. A passage
that starts or ends inside a long sentence can be missed.

Words are compared with A-Z lower-cased and white space collapsed. Only the hashes' partial minima and the repeated runs
are joined, so a passage that a third of all documents share is aggregated before the shuffle; in the join, the rows of
a hash with more than one in HOT of all anchors are dealt to several tasks.

Rows: one per input row with all its columns; text_col without what was cut, n_sentences (counted as in `dedup_spans`)
and n_removed (sentences that lost a word) added (input columns of these names are replaced). A text of which nothing is
removed comes back byte for byte. Null doc_id or null text: left as it is, n_removed 0. Rows that repeat a doc_id with
the same text are one document and are treated alike; with another text they are documents of their own, ordered by the
text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import save
from .textvec import mix, text_chunks, word_hashes, word_starts

SENTENCES, WORDS, MAX_WORDS = 2, 20, 20
WINDOW = 10
HOT = 1000  # a hash with more than this share of all anchors has its rows dealt to several tasks
_STEP = 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True


def word_ends(starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    return starts + np.add.reduceat((~space[starts[0] :]).astype(np.int64), starts - starts[0])


def breaks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words after one that ends in . ! or ?, these and the first words of lines and texts) as masks."""
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = _END[data[ends - 1]]
    stop = np.concatenate([[False], last[:-1]])
    first = stop.copy()
    first[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    at = woff[:-1]
    stop[at[at < len(starts)]] = False
    first[at[at < len(starts)]] = True
    return stop, first


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word of each sentence, sentence offsets of the texts) of a chunk of texts."""
    starts, space, woff = word_starts(data, off)
    if not len(starts):
        return starts, starts, starts, np.zeros(len(off), np.int64)
    ends = word_ends(starts, space)
    _, first = breaks(data, starts, ends, woff)
    heads = np.flatnonzero(first)
    pos = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    heads = np.flatnonzero(pos % MAX_WORDS == 0)
    return starts, ends, heads, np.searchsorted(heads, woff)


def runs(heads: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) sentences of the runs of one text, given the first words of its sentences."""
    n = len(heads)
    if n < SENTENCES or n_words - heads[0] < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.append(heads, n_words)  # sentence i has the words edge[i] to edge[i + 1]
    i = np.arange(n)
    fwd = np.maximum(np.searchsorted(edge, edge[:-1] + WORDS, "left") - 1, i + SENTENCES - 1)
    bwd = np.minimum(np.searchsorted(edge, edge[1:] - WORDS, "right") - 1, i - SENTENCES + 1)
    a, b = fwd < n, bwd >= 0
    both = np.unique(np.concatenate([i[a] * (n + 1) + fwd[a], bwd[b] * (n + 1) + i[b]]))
    return both // (n + 1), both % (n + 1)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            hashes, firsts, lasts = [], [], []
            for _, data, off in text_chunks(batch.column(1)):
                words, woff = word_hashes(data, off)
                _, _, heads, soff = sentences(data, off)
                up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), _STEP, np.uint64)]))
                down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), _BACK, np.uint64)]))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
                for d in range(len(off) - 1):
                    own = heads[soff[d] : soff[d + 1]]
                    a, b = runs(own, int(woff[d + 1]))
                    edge = np.append(own, woff[d + 1])
                    x, y = edge[a], edge[b + 1] if len(b) else b
                    h = mix((total[y] - total[x]) * down[x] + (y - x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    hashes.append(h.view(np.int64))
                    firsts.append(a.astype(np.int32))
                    lasts.append(b.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(hashes, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "hash", "first", "last"],
            )


def without(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and, but for a line break, the white space after them."""
    out, at, n = [], 0, len(starts)
    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(flips[::2], flips[1::2], strict=True):  # words a to b - 1 go
        x, y = int(starts[a]), int(ends[b - 1])
        if b == n:
            y = len(text)
        else:
            gap = text[y : int(starts[b])]
            line = gap.find(b"\n")
            whole = x == 0 or text[x - 1 : x] == b"\n"
            y += len(gap) if line < 0 else line + whole
        out.append(text[at:x])
        at = y
    out.append(text[at:])
    return b"".join(out)


def cut(text: bytes, spans: np.ndarray | None) -> tuple[bytes, int, int]:
    """(text without the sentences of the spans, its sentences, removed ones); spans: rows of (first, last)."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, heads, _ = sentences(data, np.array([0, len(data)]))
    n = len(heads)
    if spans is None or not len(spans) or not n:
        return text, n, 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] + 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return without(text, starts, ends, np.repeat(gone, np.diff(np.append(heads, len(starts))))), n, int(gone.sum())


def _cutter(n_columns: int, text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(n_columns), strict=True):
                if not text.is_valid:
                    texts.append(None)
                    counts.append(0)
                    removed.append(0)
                    continue
                own = np.array([(s["first"], s["last"]) for s in spans.as_py()], np.int64).reshape(-1, 2) if spans.is_valid else None
                new, n, gone = cut(text.as_py().encode(), own)
                texts.append(new.decode())
                counts.append(n)
                removed.append(gone)
            columns = [batch.column(i) for i in range(n_columns)]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=schema)

    return run


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated sentence runs; see the module's text."""
    plain = docs.drop("n_sentences", "n_removed")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.xxhash64(text_col).alias("text_hash")).where("doc_id is not null")
    spans = save(texts.mapInArrow(_spans, "doc_id long, text_hash long, hash array<long>, first array<int>, last array<int>"), "spans")
    flat = spans.select("doc_id", "text_hash", F.explode(F.arrays_zip("hash", "first", "last")).alias("s")).select("doc_id", "text_hash", "s.hash", "s.first", "s.last")
    place = F.struct("doc_id", "text_hash", "first")
    again = flat.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("hash", "low")
    others = flat.join(again, "hash").where(place > F.col("low")).select("doc_id", "text_hash", F.struct("first", "last").alias("span"))
    own = others.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("_spans")).toDF("_doc", "_text_hash", "_spans")
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(plain.columns)]
    keyed = plain.select(*columns, F.col(id_col).cast("long").alias("_own"), F.xxhash64(plain[text_col]).alias("_own_hash"))
    both = keyed.join(own, (F.col("_own") == F.col("_doc")) & (F.col("_own_hash") == F.col("_text_hash")), "left").select(*[f"_c{i}" for i in range(len(columns))], "_spans")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return both.mapInArrow(_cutter(len(columns), plain.columns.index(text_col), [*plain.columns, "n_sentences", "n_removed"]), schema)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor words, hashes of the WORDS words from them, word offsets of the texts) of a chunk of texts."""
    starts, space, woff = word_starts(data, off)
    words, _ = word_hashes(data, off)
    n = len(words)
    if n < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), woff
    stop, first = breaks(data, starts, word_ends(starts, space), woff)
    with np.errstate(over="ignore"):
        weight = np.cumprod(np.full(WORDS, np.uint64(_STEP)))
        run = np.zeros(n - WORDS + 1, np.uint64)
        for j in range(WORDS):
            run += words[j : j + len(run)] * weight[j]
        run = mix(run)
    end = np.repeat(woff[1:], np.diff(woff))  # of each word's text
    whole = np.arange(len(run)) + WORDS <= end[: len(run)]
    chosen = first[: len(run)] & whole
    m = len(run) - WINDOW + 1
    if m > 0:
        stops = np.concatenate([[0], np.cumsum(stop)])
        free = np.flatnonzero((np.arange(m) + WINDOW - 1 + WORDS <= end[:m]) & (stops[WINDOW : m + WINDOW] == stops[:m]))
        chosen[free + np.lib.stride_tricks.sliding_window_view(run, WINDOW)[free].argmin(axis=1)] = True
    at = np.flatnonzero(chosen)
    return at, run[at], woff


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, places, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, data, off in text_chunks(batch.column(2)):
            at, run, woff = anchors(data, off)
            edge = np.searchsorted(at, woff)
            hashes.append(run)
            places.append(at - np.repeat(woff[:-1], np.diff(edge)))
            counts.append(np.diff(edge))
        offsets = pa.array(np.cumsum(np.concatenate(counts)), pa.int32())
        hash_ = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes).view(np.int64)))
        place = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(places), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hash_, place], names=["doc_id", "text_hash", "hash", "at"])


def _short(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words in 24 bits, word offsets of the texts)."""
    words, woff = word_hashes(data, off)
    return (words >> np.uint64(40)).astype("<u4"), woff


def _bytes(words: np.ndarray) -> bytes:
    """Three bytes a word."""
    return words.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _around(text_at: int):
    """The WINDOW words on either side of the wanted anchors of each text; the last columns are doc_id, text_hash and picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("picks").is_valid()).select([text_at, batch.num_columns - 3, batch.num_columns - 2, batch.num_columns - 1])
            rows = []
            for i, data, off in text_chunks(batch.column(0)):
                words, woff = _short(data, off)
                for d in range(len(off) - 1):
                    own = words[woff[d] : woff[d + 1]]
                    doc, text = batch.column(1)[i + d].as_py(), batch.column(2)[i + d].as_py()
                    for s in batch.column(3)[i + d].as_py():
                        a, b = s["at"], s["at"] + WORDS
                        rows.append((s["hash"], doc, text, a, _bytes(own[max(0, a - WINDOW) : a]), _bytes(own[b : b + WINDOW])))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["hash", "low_doc", "low_text", "low_at", "before", "after"])

    return run


def _matches(words: np.ndarray, at: np.ndarray, room: np.ndarray, raw: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on, in direction `step`, equal those in raw; place: the first byte of the first of these."""
    n, alive = np.zeros(len(at), np.int64), room > 0
    for j in range(WINDOW):
        live = np.flatnonzero(alive)
        if not len(live):
            break
        x = place[live] + 3 * step * j
        alive[live] = (words[at[live] + step * j] == raw[x] | raw[x + 1] << np.uint32(8) | raw[x + 2] << np.uint32(16)) & (room[live] > j)
        n += alive
        alive &= room > j + 1
    return n


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as 32-bit numbers, offsets) of a binary column."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)).astype(np.uint32), off


def repeated(words: np.ndarray, woff: np.ndarray, of: np.ndarray, repeats: pa.StructArray) -> np.ndarray:
    """Which words of a chunk are shared with first occurrences; of: the text of each repeat."""
    at = woff[of] + repeats.field("at").to_numpy().astype(np.int64)
    (before, boff), (after, aoff) = _binary(repeats.field("before")), _binary(repeats.field("after"))
    a = at - _matches(words, at - 1, np.minimum(np.diff(boff) // 3, at - woff[of]), before, boff[1:] - 3, -1)
    end = at + WORDS
    b = end + _matches(words, end, np.minimum(np.diff(aoff) // 3, woff[of + 1] - end), after, aoff[:-1], 1)
    low = repeats.field("low_at").fill_null(-WORDS).to_numpy().astype(np.int64) + WORDS  # of those in the same text
    a = np.maximum(a, woff[of] + low)
    some = a < b
    edge = np.bincount(a[some], minlength=len(words) + 1) - np.bincount(b[some], minlength=len(words) + 1)
    return np.cumsum(edge[: len(words)]) > 0


def _passage_cutter(n_columns: int, text_at: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = batch.column(text_at), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            found: pa.ListArray = batch.column(n_columns)
            size = found.value_lengths().fill_null(0).to_numpy()
            edge = np.concatenate([[0], np.cumsum(size)])
            flat = found.flatten()
            changed: dict[int, str] = {}
            for i, data, off in text_chunks(texts):
                n = len(off) - 1
                starts, ends, heads, soff = sentences(data, off)
                counts[i : i + n] = np.diff(soff)
                if edge[i] == edge[i + n]:
                    continue
                words, woff = _short(data, off)
                gone = repeated(words, woff, np.repeat(np.arange(n), size[i : i + n]), flat.slice(edge[i], edge[i + n] - edge[i]))
                lost = np.logical_or.reduceat(gone, heads).astype(np.int64)
                removed[i : i + n] = np.diff(np.concatenate([[0], np.cumsum(lost)])[soff])
                for d in np.flatnonzero(removed[i : i + n]):
                    x, y = woff[d], woff[d + 1]
                    changed[i + d] = without(data[off[d] : off[d + 1]].tobytes(), starts[x:y] - off[d], ends[x:y] - off[d], gone[x:y]).decode()
            columns = [batch.column(i) for i in range(n_columns)]
            if changed:
                new = texts.to_pylist()
                for i, text in changed.items():
                    new[i] = text
                columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed)], names=schema)

    return run


def _dealt(flat: DataFrame, hot: DataFrame, lows: DataFrame) -> DataFrame:
    """The rows of flat beside those of lows with their hash; the rows of a hot hash are dealt to several tasks.

    hot (hash, parts) has at most HOT rows, so it may be broadcast whatever the size of the corpus.
    """
    many, parts = F.broadcast(hot), F.col("parts")
    key = lambda part: F.when(parts.isNull(), F.col("hash")).otherwise(F.xxhash64("hash", part))
    salted = flat.join(many, "hash", "left").withColumn("key", key(F.pmod(F.xxhash64("doc_id", "place"), parts))).drop("parts", "hash")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)).cast("long") - 1))
    once = lows.join(many, "hash", "left").withColumn("part", copies).withColumn("key", key(F.col("part"))).drop("parts", "part", "hash").dropDuplicates(["key"])
    return salted.join(once, "key")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated passages, wherever they start; see the module's text."""
    plain = docs.drop("n_sentences", "n_removed")
    doc, text_hash = F.col(id_col).cast("long"), F.hash(plain[text_col])
    texts = plain.select(doc.alias("doc_id"), text_hash.alias("text_hash"), plain[text_col].alias("text")).where("doc_id is not null and text is not null")
    found = Observation()
    spans = save(texts.mapInArrow(_anchors, "doc_id long, text_hash int, hash array<long>, at array<int>"), "anchors", found, F.sum(F.size("hash")).alias("n"))
    anchors_ = F.explode(F.arrays_zip("hash", "at")).alias("s")
    # a place in one number: the text's hash, then the word
    flat = spans.select("doc_id", "text_hash", anchors_).select("doc_id", (F.shiftleft(F.col("text_hash").cast("long"), 32) + F.col("s.at")).alias("place"), "s.hash")
    of_text, word = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    again = save(flat.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("low"), F.count("*").alias("n")).where("n > 1").select("hash", "low.*", "n"), "again")
    least = max(1, -(-(found.get["n"] or 0) // HOT))  # of the anchors, in a hot hash
    hot = again.where(F.col("n") > least).select("hash", F.ceil(F.col("n") / least).cast("int").alias("parts"))
    # both joins below have one and the same left side, so the texts are shuffled once
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(plain.columns)]
    keyed = plain.select(*columns, doc.alias("_own"), text_hash.alias("_own_hash"))
    match = (F.col("_own") == F.col("_doc")) & (F.col("_own_hash") == F.col("_text_hash"))
    wanted = again.groupBy("doc_id", of_text.alias("text_hash")).agg(F.collect_list(F.struct("hash", word.alias("at"))).alias("picks")).toDF("_doc", "_text_hash", "picks")
    at = plain.columns.index(text_col)
    lows = keyed.join(wanted, match, "left").drop("_doc", "_text_hash").mapInArrow(_around(at), "hash long, low_doc long, low_text int, low_at int, before binary, after binary")
    same = (F.col("doc_id") == F.col("low_doc")) & (of_text == F.col("low_text"))
    others = _dealt(flat, hot, lows).where(~same | (word != F.col("low_at")))
    repeats = others.select("doc_id", of_text.alias("text_hash"), F.struct(word.alias("at"), F.when(same, F.col("low_at")).alias("low_at"), "before", "after").alias("r"))
    own = repeats.groupBy("doc_id", "text_hash").agg(F.collect_list("r").alias("_repeats")).toDF("_doc", "_text_hash", "_repeats")
    both = keyed.join(own, match, "left").drop("_doc", "_text_hash", "_own", "_own_hash")
    schema = T.StructType([*plain.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return both.mapInArrow(_passage_cutter(len(columns), at, [*plain.columns, "n_sentences", "n_removed"]), schema)
