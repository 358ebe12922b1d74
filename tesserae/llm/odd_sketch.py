"""MinHash near-duplicate groups with odd sketches.

1. One pass over the texts gives each document its set size, a digest of its shingle set, band keys of its MinHash
   samples and an odd sketch: the samples folded into a parity bitmap.
2. Documents with one and the same set form a class, represented by the smallest doc_id; only representatives go on.
3. Representatives that share a band key are candidates; only their texts are kept, as sets of hashes, after one semi-join.
   First each meets the smallest one of each of its bands; what the sketches don't rule out is confirmed, and confirmed
   links are joined to components.
4. Where a band then still holds several components, its members get larger sketches, of FINE samples. Blocks of at most
   about BLOCK_ROWS members of a band meet; the population count of the XOR of two sketches estimates the similarity, and
   only pairs of different components that may reach the threshold leave the task, each from the first band it shares.
   Pairs inside one component cannot change it, so a group of n near copies costs about n pairs.
5. Pairs are confirmed on the full shingle sets with integer arithmetic.

Rows: one per input row. Null doc_id: takes no part, component null, kept. Null or blank text: empty set, alone in its
group. Rows that repeat a doc_id are one document. More columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import save
from .textvec import mix, shingle_sets, text_chunks

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 32, 4  # a pair at 75 % shares no band with a probability below 1e-5
BITS = 512
FINE, FINE_BITS = 1024, 4096
SLACK, FINE_SLACK = 5.0, 4.0  # standard deviations by which a sketch may fall short of the threshold
BLOCK_ROWS = 2048

_rng = np.random.default_rng(7_001)
_XOR = _rng.integers(0, 2**32, FINE, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 2**32, FINE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

SIGNATURE = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, sketch array<long>"


def min_hash(shingles: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The first `count` MinHash samples of a non-empty set of 64-bit hashes."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 16) // count)
    with np.errstate(over="ignore"):
        for i in range(0, len(small), step):
            np.minimum(least, ((small[i : i + step, None] ^ _XOR[:count]) * _MUL[:count]).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """The key of each band, from its number and its samples."""
    rows = samples[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap of the samples, as 64-bit words."""
    with np.errstate(over="ignore"):
        at = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def most_bits(percent: int = PERCENT, k: int = BANDS * ROWS, bits: int = BITS, slack: float = SLACK) -> int:
    """The largest XOR population count at which a pair may still reach the threshold, `slack` deviations allowed."""
    miss = 1 - percent / 100
    even = math.exp(-4 * k * miss / bits)
    odd = 0.5 * (1 - even)
    spread = math.sqrt((2 * even * math.sqrt(k * miss * (1 - miss))) ** 2 + bits * odd * (1 - odd))
    return math.ceil(bits * odd + slack * spread)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands, sketches = [], [], [], []
        for _, data, off in text_chunks(batch.column(1)):
            for own in shingle_sets(data, off, WIDTH):
                sizes.append(len(own))
                if not len(own):
                    digests.append((0, 0))
                    bands.append(None)
                    sketches.append(None)
                    continue
                with np.errstate(over="ignore"):
                    twice = mix(own + np.uint64(0x51ED270B9F3C2A17))
                    digests.append(tuple(np.array([own.sum() * np.uint64(3) + np.uint64(len(own)), twice.sum()], np.uint64).view(np.int64).tolist()))
                samples = min_hash(own)
                bands.append(band_keys(samples).view(np.int64))
                sketches.append(odd_sketch(samples).view(np.int64))
        a, b = zip(*digests, strict=True) if digests else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest_a", "digest_b", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data, off in text_chunks(batch.column(1)):
            found = [own.tobytes() for own in shingle_sets(data, off, WIDTH)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(found)), pa.array(found, pa.binary())], names=["id", "set"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            sizes, sketches, bands = [], [], []
            for raw in batch.column(1).slice(i, 512):
                own = np.frombuffer(raw.as_py(), np.uint64)
                sizes.append(len(own))
                samples = min_hash(own, FINE) if len(own) else np.zeros(FINE, np.uint32)
                sketches.append(odd_sketch(samples, FINE_BITS).tobytes())
                bands.append(band_keys(samples).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.binary())], names=["rep", "n", "fine", "keys"])


def _meet(percent: int):
    """Pairs (a, b) of different components that the sketches allow; rows come sorted by band and block pair."""
    most = most_bits(percent, FINE, FINE_BITS, FINE_SLACK)

    def pairs(band: int, low: int, high: int, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = rows["keys"]
        own = int(np.flatnonzero(keys[0] == np.uint32(band & 0xFFFFFFFF))[0])
        first, second = np.flatnonzero(rows["block"] == low), np.flatnonzero(rows["block"] == high)
        a, b = [], []
        for k, i in enumerate(first):
            at = second[k + 1 :] if low == high else second
            at = at[rows["part"][at] != rows["part"][i]]
            n, m = rows["n"][at], rows["n"][i]
            at = at[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            at = at[np.bitwise_count(rows["fine"][at] ^ rows["fine"][i]).sum(axis=1) <= most]
            at = at[(keys[at] == keys[i]).argmax(axis=1) == own]
            a.append(np.full(len(at), rows["rep"][i]))
            b.append(rows["rep"][at])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def grouped(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "low", "high", "block", "part", "rep", "n")}
        rows["fine"] = np.frombuffer(b"".join(batch.column("fine").to_pylist()), np.uint64).reshape(len(batch), -1)
        rows["keys"] = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32).reshape(len(batch), -1)
        new = np.ones(len(batch), bool)
        new[1:] = (rows["band"][1:] != rows["band"][:-1]) | (rows["low"][1:] != rows["low"][:-1]) | (rows["high"][1:] != rows["high"][:-1])
        return rows, np.append(np.flatnonzero(new), len(batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the block pair that a batch may have cut
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
            if not held:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            if not whole:
                continue
            rows, edge = grouped(whole[0])
            until = len(edge) - 1 if batch is None else len(edge) - 2
            held = [whole[0].slice(edge[until])] if batch is not None else []
            found = [pairs(int(rows["band"][x]), int(rows["low"][x]), int(rows["high"][x]), {c: v[x:y] for c, v in rows.items()}) for x, y in zip(edge[:until], edge[1 : until + 1], strict=True)]
            if found:
                a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(b) < len(a):
                    a, b = b, a
                both = 0
                if 100 * len(a) >= percent * len(b):
                    at = np.searchsorted(b, a)
                    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see the module's text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = save(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    digest = ["n_shingles", "digest_a", "digest_b"]
    classes = full.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    members = save(full.select("doc_id", *digest).join(classes, digest).select("doc_id", "rep"), "members")
    # a document that repeats under several texts ties their classes together
    ties = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    ties = members.join(ties.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    # a representative has one row for each of its digests; rows that repeat it exactly are made one
    reps = save(full.join(classes.withColumnRenamed("rep", "doc_id"), [*digest, "doc_id"]).dropDuplicates(["doc_id", *digest]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), "representatives")

    slots = reps.select("rep", F.explode("bands").alias("band"))
    hubs = slots.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("band", "hub")
    shared = save(slots.join(hubs, "band"), "bands")  # only bands of several representatives
    first = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    # all texts are shuffled once, those of representatives that share a band stay; an id has a row for each of its sets
    some = shared.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = save(texts.where("doc_id is not null").join(some, "doc_id", "left_semi").mapInArrow(_sets, "id long, set binary").dropDuplicates(), "sets")
    near = save(_confirmed(_sketched(first, reps, percent), sets, percent).unionByName(ties), "links")

    found = components(near, "a", "b")
    placed = shared.select("band", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    split = placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band")
    placed = save(placed.join(split, "band").select("band", "rep", "part").distinct(), "split")
    late = sets.join(placed.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    fine = save(late.mapInArrow(_fine, "rep long, n long, fine binary, keys binary"), "fine")
    blocks = placed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocked = placed.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    # a large band is dealt out before its rows are repeated for the blocks they meet
    blocked = blocked.hint("rebalance", "band", "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = blocked.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "part", "rep").join(fine, "rep")
    # a document with several texts has several sets, of which only one need be in the band
    met = met.where(F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("keys"), i * 4 + 1, F.lit(4)) == _low_bytes(F.col("band"))))
    met = met.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "rep")
    cross = met.mapInArrow(_meet(percent), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = save(_confirmed(cross, sets, percent), "links")
    # the new links join components, which are few beside the documents
    label = found.select(F.col("node").alias("rep"), "component")
    part = lambda c: more.select("a", "b").join(label.select(F.col("rep").alias(c), F.col("component").alias("p" + c)), c, "left")
    joined = part("a").join(label.select(F.col("rep").alias("b"), F.col("component").alias("pb")), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    merged = components(joined, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("top"))
    placed_docs = members.join(label, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component")).join(merged, "component", "left")
    placed_docs = placed_docs.groupBy("doc_id").agg(F.min(F.coalesce("top", "component")).alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(placed_docs, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _low_bytes(band: Column) -> Column:
    """The low 32 bits of a key as little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(band, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))


def _sketched(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and odd sketches allow the threshold."""
    left = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    bits = sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64))
    sizes = (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)
    return pairs.join(left, "a").join(right, "b").where(sizes & (bits <= most_bits(percent))).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    pairs = save(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = save(sets.join(ids, "id", "left_semi"), "paired")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")
