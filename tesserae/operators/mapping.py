"""Mapping a table of tags to a table of references: seeds, then exact alignment of the pairs that share one.

An alignment that loses at most `loss` of a tag's full score has at most e = loss / (least loss of one error) errors. Cut
into e + 1 parts, one part of the tag is then whole, so every pair worth looking at shares the first letters of a part
with the reference. Parts' seeds have as many letters as the shortest part allows, up to LONGEST; references are cut into
windows of the lengths that occur, at most LONGEST of them. Equal tags are one. Seeds meet by a join, whose pairs are told apart before any
text follows them; texts are joined to pairs and aligned whole, begins being carried beside the scores. Tags whose seeds
would be shorter than SHORTEST, or with an N, meet all references in blocks of BLOCK tags.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import clean
from .kernels import MAP_SCORES, Kernel, tag_profile

SHORTEST, LONGEST, BLOCK, PARTS = 3, 16, 256, 4
PLACES = "begin int, end int, score int"


def least_loss(scores: dict = MAP_SCORES) -> int:
    """What one error takes from a tag's full score at least: a mismatch, a letter left out, or letters between."""
    s, t = scores["Scores"], scores["Transitions"]
    mismatch = s["Match"] - s["MisMatch"]
    deletion = s["Match"] - s["Deletion"] + min(0, t["MM"] - t["DD"])
    insertion = t["MM"] - t["MI"] - t["IM"] - s["Insertion"] if s["Insertion"] + t["II"] <= 0 else 0
    return min(mismatch, deletion, insertion)


def _aligned(scores: dict, loss: int):
    """Rows of (tag id, tag, reference id, reference) or (list of tag ids and tags, ...) to places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels: dict[str, tuple[Kernel, int]] = {}
        for batch in batches:
            tags, refs, letters = batch.column("tags").to_pylist(), batch.column("ref"), batch.column("letters").to_pylist()
            by_tag: dict[str, dict[int, list]] = {}
            for i, own in enumerate(tags):
                for t in own:
                    by_tag.setdefault(t["tag"], {}).setdefault(i, []).append(t["id"])
            at, ids, places = [], [], []
            for tag, rows in by_tag.items():
                if tag not in kernels:
                    if len(kernels) >= 1024:
                        kernels.clear()
                    own = Kernel(tag_profile(tag, scores))
                    kernels[tag] = own, int(own.best_scores([own.encode(tag)])[0]) - loss
                kernel, bound = kernels[tag]
                for (i, names), found in zip(rows.items(), kernel.many_hits([letters[i] for i in rows], bound, 1, first=True, paths=False), strict=True):
                    for h in found:
                        for name in names:
                            at.append(i)
                            ids.append(name)
                            places.append((h.seq_begin, h.seq_end, h.score))
            begin, end, score = zip(*places, strict=True) if places else ((), (), ())
            kind = batch.schema.field("tags").type.value_type.field("id").type
            columns = [refs.take(pa.array(at, pa.int64())), pa.array(ids, kind), *[pa.array(c, pa.int32()) for c in (begin, end, score)]]
            yield pa.RecordBatch.from_arrays(columns, names=["ref", "id", "begin", "end", "score"])

    return run


def map_tables(references: DataFrame, tags: DataFrame, loss: int, scores: dict = MAP_SCORES, key: str = "seq_id", text: str = "raw", tag_key: str = "tag_id", tag_text: str = "tag") -> DataFrame:
    """key, tag_key, begin, end, score: the best place of each tag in each reference, the first on a tie, where it is at
    most `loss` below the score that the tag has with itself. begin and end count from 0.

    Keys must be distinct in their tables and have different names. Null and empty tags and references give no row; N in
    a tag matches all. A tag that no error can cheapen (see least_loss) is refused.
    """
    if key == tag_key or {key, tag_key} & {"begin", "end", "score"}:
        raise ValueError("rename the keys")
    step = least_loss(scores)
    if step <= 0:
        raise ValueError("an error takes nothing from the score, so no seed is sure")
    parts = loss // step + 1
    refs = references.select(F.col(key).alias("ref"), clean(F.col(text)).alias("letters")).where("letters <> ''")
    named = tags.select(F.col(tag_key).alias("_id"), clean(F.col(tag_text)).alias("_tag")).where("_tag <> ''")
    own = named.select(F.col("_tag").alias("tag")).distinct().withColumn("id", F.col("tag"))  # equal tags are mapped once
    seed = F.least(F.floor(F.length("tag") / parts), F.lit(LONGEST)).cast("int")
    plain = own.withColumn("k", seed).withColumn("all", (F.col("k") < SHORTEST) | F.contains("tag", F.lit("N")))
    sizes = sorted(r["k"] for r in plain.where("not all").select("k").distinct().collect())  # LONGEST numbers at most
    cut = lambda i: F.substring(F.col("tag"), F.floor(i * F.length("tag") / parts).cast("int") + 1, F.col("k"))
    seeds = plain.where("not all").select("id", "k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), cut))).alias("seed"))
    windows = refs.select("ref", "letters", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")) if sizes else None
    out = []
    if sizes:
        starts = F.sequence(F.lit(1), F.greatest(F.length("letters") - F.col("k") + 1, F.lit(1)))
        words = windows.select("ref", "k", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("letters"), i, F.col("k"))))).alias("seed"))
        pairs = words.join(seeds, ["k", "seed"]).select("ref", "id").distinct()
        # the references of a tag come together, in PARTS parts, so that they are aligned side by side
        texts = pairs.join(refs, "ref").repartition(4 * refs.sparkSession.sparkContext.defaultParallelism, F.col("id"), F.pmod(F.xxhash64("ref"), F.lit(PARTS)))
        out.append(texts.sortWithinPartitions("id").select("ref", "letters", F.array(F.struct("id", F.col("id").alias("tag"))).alias("tags")))
    block = plain.where("all").select(F.struct("id", "tag").alias("t"), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"))
    count = plain.where("all").count()
    if count:
        blocks = block.groupBy(F.pmod("h", F.lit(-(-count // BLOCK))).alias("b")).agg(F.collect_list("t").alias("tags"))
        out.append(refs.crossJoin(blocks).select("ref", "letters", "tags"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((refs, "ref"), (own, "id"))}
    schema = f"ref {kinds['ref']}, id {kinds['id']}, {PLACES}"
    made = [rows.mapInArrow(_aligned(scores, loss), schema) for rows in out] or [refs.sparkSession.createDataFrame([], schema)]
    found = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    return found.join(named, F.col("id") == F.col("_tag")).select(F.col("ref").alias(key), F.col("_id").alias(tag_key), "begin", "end", "score")
