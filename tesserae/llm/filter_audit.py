"""Which filters remove what, in every order: an audit from counts of failure masks by a multilinear extension.

Each document gets a mask of the filters it fails, and all that is kept of a part (a language) is how many documents
have each mask. With x_i the degree to which filter i is on, the documents removed are the polynomial

    f(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)),

linear in each x_i. Its corners are the counts of any set of filters: survivors of a step, what it removes, what it
alone would catch. The Shapley value of filter i is the integral of its partial derivative along the diagonal, made
with exact rationals and scaled by the number of orders, so that it is the integer sum over all orders.

The mask of a text needs its words, letters and digest only; a text equal to that of a smaller doc_id anywhere in the
table fails the last filter, removed or not. Texts never move: rows of (doc_id, part, digest, mask, labels) are saved
and grouped; the first document of each text is found by a minimum that is taken before the shuffle, and joined back by
(digest, doc_id), so that no group of copies, however large, meets in a task.

Null texts are empty ones: they fail A alone, and E if an earlier text is empty. A null language is the empty string. A
null doc_id has no label and no smaller one, so it never fails E, nor makes another fail. Repeated rows count each;
copies of the smallest doc_id do not fail E by each other. A document is good or toxic if any of its label rows says so,
labels that are null say nothing. An empty table gives no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import save

SPACE = r"[\x20\x09-\x0D]+"

#: Filters on a text and its words, true where it fails; `DUPLICATE` comes last.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.size(F.split(text, "[A-Z]")) - 1) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removal:
    """The removal polynomial of counts by mask: its coefficients by set of variables."""

    def __init__(self, counts: dict[int, int], n: int):
        self.n, self.total = n, sum(counts.values())
        self.coefficient: dict[int, int] = {}
        for s in range(1, 1 << n):
            above = sum(c for m, c in counts.items() if m & s == s)
            if above:
                self.coefficient[s] = -above if s.bit_count() % 2 == 0 else above

    def at(self, corner: int) -> int:
        """Documents that the filters of a corner remove together."""
        return sum(c for s, c in self.coefficient.items() if s & corner == s)

    def partial(self, i: int) -> dict[int, int]:
        """The partial derivative by filter i: coefficients by the other variables."""
        return {s & ~(1 << i): c for s, c in self.coefficient.items() if s >> i & 1}

    def shapley(self, i: int) -> int:
        """The integral of the partial derivative along the diagonal, times the number of orders."""
        value = sum((Fraction(c, s.bit_count() + 1) for s, c in self.partial(i).items()), Fraction(0)) * factorial(self.n)
        if value.denominator != 1:
            raise ArithmeticError(f"{value} is no whole number")
        return int(value)


def steps(part: str, counts: dict[int, tuple[int, int, int]], letters: str) -> Iterator[tuple]:
    """A row for each step of each order, from (documents, good ones, toxic ones) by mask."""
    n = len(letters)
    every, good, toxic = (Removal({m: c[k] for m, c in counts.items()}, n) for k in range(3))
    whole = (1 << n) - 1
    of = [{corner: p.at(corner) for corner in range(whole + 1)} for p in (every, good, toxic)]
    shapley = [every.shapley(i) for i in range(n)]
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            removed, good_lost, toxic_lost = (p[now] - p[before] for p in of)
            yield part, "".join(letters[j] for j in order), step, every.total - of[0][now], removed, of[0][1 << i] - removed, of[0][whole] - of[0][whole & ~(1 << i)], good_lost, toxic_lost, shapley[i]
            before = now


def _expand(letters: str):
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = zip(*steps(part, {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}, letters), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return run


def masks(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest, mask of each document: the bits of the filters that its text fails, the first is 1."""
    filters = FILTERS if filters is None else filters
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [F.when(f(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, f in enumerate(filters.values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters, duplicates being the last bit."""
    filters = FILTERS if filters is None else filters
    duplicate = 1 << len(filters)
    own = masks(docs, filters, id_col, text_col, part_col)
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
    said = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("_salt", F.lit(0).cast("long"))
    # null ids match no label and are dealt out by their row instead of meeting in one task
    own = own.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(0))
    flag = lambda c: F.coalesce(c, F.lit(0)).cast("tinyint").alias(c)
    rows = save(own.join(said, ["_id", "_salt"], "left").select("doc_id", "part", "digest", "mask", flag("good"), flag("toxic")), "masks")
    sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(first, ["digest", "doc_id"], "left_semi").groupBy("part", "mask").agg(*sums)
    others = rows.groupBy("part", "mask", F.col("doc_id").isNull().alias("_free")).agg(*sums)
    # every document with an id is counted as a duplicate, and the first of each text moved from there
    moved = lambda df, mask, sign: df.select("part", mask.alias("mask"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
    late = F.col("mask") + duplicate
    found = moved(others, F.when(F.col("_free"), F.col("mask")).otherwise(late), 1).unionByName(moved(firsts, late, -1)).unionByName(moved(firsts, F.col("mask"), 1))
    return found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text.

    kept: documents after the step; removed: by it; redundant: fail its filter but went before; unique_fails: fail no
    other; good_lost, toxic_lost: labelled ones among the removed; shapley: what its filter removes, summed over orders.
    """
    filters = FILTERS if filters is None else filters
    counts = mask_counts(docs, labels, filters, id_col, text_col, part_col)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # one item a mask
    return by_part.mapInArrow(_expand("".join(filters) + DUPLICATE), AUDIT)
