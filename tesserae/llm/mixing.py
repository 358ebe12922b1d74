"""Mixing sources to target weights by fitting subset sums over document lengths.

Sources share a budget by weight; a source gives at most `max_epochs` times its size, and what it cannot give is shared
again by weight. Per source only a histogram of exact document lengths is needed: whole epochs first, then of every
length the same share of its documents, then a bounded-knapsack dynamic programme picks counts of the documents left
over so that the rest of the target is met as nearly as possible. Documents of a length are picked in the order of a
seeded hash, and ties of the hash by doc_id.

A histogram holds one row per distinct length, so it is bounded by the longest document, not by the rows. The seeded
pick ranks documents inside hash slots of a length, whose number grows with the rows, so of a length that a third of all
rows have one task ranks at most about a million, however large the table.

Rows: one per input row. Null text has size 0 and gives 0. A null source is a source of its own, ordered last. Rows that
repeat a doc_id are separate documents as long as the rows differ in anything that orders them; the number of repeats
taken is right in any case. More columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import save

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SLOTS, SLOT_ROWS = 64, 1_000_000  # hash slots of a length, one more for each SLOT_ROWS rows beyond: what one task ranks of a hot length
SEED = 20240601
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> list[float]:
    """The target of each source, given the sizes in their order; exact fractions inside."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    budget = Fraction(sum(sizes) * percent, 100)
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(out[i] for i in range(len(sizes)) if i not in open_)
        total = sum(weight[i] for i in open_)
        share = {i: left * weight[i] / total for i in open_}
        over = {i for i in open_ if share[i] > epochs * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(epochs * sizes[i]) if over else share[i]
        open_ = open_ - over if over else set()
    return [float(x) for x in out]


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts per length, within `counts`, whose words come as near to budget as found; lengths > 0, distinct.

    The same share of every length is taken first. The words still missing are then fitted: large lengths fill until
    less than twice the longest length is missing, and a bounded-knapsack dynamic programme over that rest decides.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * take).sum())
    left = counts - take
    window = 2 * int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= window:
            break
        n = min(int(left[i]), (rest - window) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i] += n
        left[i] -= n
        rest -= n * int(lengths[i])
    picked = knapsack(lengths, left, rest)
    return take + picked


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts whose sum of lengths is the nearest reachable to budget, preferring at most budget.

    Reachable sums are one big integer's bits; counts are split into powers of two. A step is kept only while the
    budget is not yet met exactly.
    """
    picked = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return picked
    top = budget + int(lengths.max())
    mask = (1 << (top + 1)) - 1
    reach, steps = 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, left, part = int(lengths[i]), min(int(counts[i]), top // int(lengths[i])), 1
        while left > 0 and not reach >> budget & 1:
            n = min(part, left)
            new = (reach | reach << n * size) & mask
            if new != reach:
                steps.append((i, n, reach))
                reach = new
            left -= n
            part *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    at = below
    if below < budget and above:
        nearest = budget + (above & -above).bit_length()
        at = nearest if nearest - budget < budget - below else below
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            at -= n * int(lengths[i])
            picked[i] += n
    return picked


def _quotas(own: pd.DataFrame) -> pd.DataFrame:
    """epochs and extra documents for each length of one source."""
    sizes, counts, target = own["size"].to_numpy(), own["n"].to_numpy(), float(own["target"].iloc[0])
    used = sizes > 0
    epochs, extra = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    if used.any():
        total = int((sizes[used] * counts[used]).sum())
        whole = int(target // total)
        epochs[:] = whole
        if whole < MAX_EPOCHS:
            extra[used] = fit(sizes[used], counts[used], round(target - whole * total))
    return own[["source_key", "size", "source_size", "target"]].assign(epochs=epochs, extra=extra)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs, and the columns in keep.

    See the module's text. copies says how often the mix takes the document.
    """
    spark = docs.sparkSession
    key = ["source_key", "size", "slot"]
    slots_of = max(SLOTS, docs.count() // SLOT_ROWS)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("source_key"),  # null is ""
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(slots_of)).alias("slot"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    fine = save(base.groupBy(*key).agg(F.count("*").alias("n")), "lengths")
    lengths = fine.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    # one row per source reaches the driver: sources name data sets, of which there are few; more are refused
    per = [(r[0], int(r[1])) for r in fine.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n"))).limit(MAX_SOURCES + 1).collect()]
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda x: (x[0] == "", x[0]))
    shares = targets([n for _, n in per], weights, percent)
    plan = spark.createDataFrame([(s, n, t) for (s, n), t in zip(per, shares, strict=True)], "source_key string, source_size long, target double")

    quota = lengths.join(plan, "source_key").groupBy("source_key").applyInPandas(_quotas, "source_key string, size long, source_size long, target double, epochs long, extra long")
    # of the extra documents of a length, low hash slots give all theirs and one slot gives a part
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = fine.withColumn("before", before).join(quota, ["source_key", "size"])
    slots = slots.select(*key, "source_size", "target", "epochs", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"))

    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id"))
    copies = (F.col("epochs") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).cast("long")
    out = base.withColumn("rank", rank).join(slots, key).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
