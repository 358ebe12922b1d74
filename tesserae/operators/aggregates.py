"""Histograms, densities, contingency counts and limits; all are partial and final aggregates of Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """bin, n for every whole number from low to high, zeros included."""
    counts = df.select(value.cast("long").alias("bin")).where(F.col("bin").between(low, high)).groupBy("bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def missed(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """missed: how many values a histogram of the range leaves out."""
    return df.select(F.count_if(F.coalesce(~value.between(low, high), F.lit(True))).alias("missed"))


def histogram_with_cycles(df: DataFrame, score: Column, cycles: Column, low: int, high: int, cycle_range: tuple[int, int]) -> DataFrame:
    """A score histogram of the rows whose cycles are in a range."""
    return histogram(df.where(cycles.between(*cycle_range)), score, low, high)


def cycle_histogram(df: DataFrame, score: Column, cycles: Column, low: int, high: int, score_range: tuple[int, int] | None = None) -> DataFrame:
    """A cycle histogram; rows whose score is out of a given range count as no cycles."""
    value = cycles if score_range is None else F.when(score.between(*score_range), cycles).otherwise(0)
    return histogram(df, value, low, high)


def near_border(begin: Column, end: Column, length: Column, clip: tuple[int, int]) -> Column:
    """Whether a histogram leaves out an alignment for lying at a border: begin <= clip[0] or end + clip[1] >= length.

    The border clip of hits is another one, which keeps what lies exactly at the distance.
    """
    return (begin <= clip[0]) | (end + clip[1] >= length)


def density(df: DataFrame, score: Column, cycles: Column, scores: tuple[int, int], counts: tuple[int, int]) -> DataFrame:
    """score, cycles, n over two half-open ranges, zeros included."""
    spark = df.sparkSession
    found = df.select(score.cast("long").alias("score"), cycles.cast("long").alias("cycles"))
    found = found.where((F.col("score") >= scores[0]) & (F.col("score") < scores[1]) & (F.col("cycles") >= counts[0]) & (F.col("cycles") < counts[1]))
    found = found.groupBy("score", "cycles").agg(F.count("*").alias("n"))
    grid = spark.range(*scores).withColumn("cycles", F.explode(F.sequence(F.lit(counts[0]).cast("long"), F.lit(counts[1] - 1).cast("long")))).withColumnRenamed("id", "score")
    return grid.join(found, ["score", "cycles"], "left").select("score", "cycles", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contingency(df: DataFrame, value: Column, truth: Column, thresholds: list[int]) -> DataFrame:
    """threshold, tp, fp, tn, fn: a value of at least the threshold is positive. One pass, counts for all thresholds."""
    rows = df.select(value.alias("v"), truth.cast("boolean").alias("t"))
    aggs = [F.struct(F.lit(x).cast("long").alias("threshold"), *[F.count_if(c).alias(n) for n, c in _cells(x)]).alias(f"x{i}") for i, x in enumerate(thresholds)]
    return rows.agg(*aggs).select(F.explode(F.array(*[f"x{i}" for i in range(len(thresholds))])).alias("x")).select("x.*")


def _cells(x: int) -> list[tuple[str, Column]]:
    positive, true = F.col("v") >= x, F.col("t")
    return [("tp", positive & true), ("fp", positive & ~true), ("tn", ~positive & ~true), ("fn", ~positive & true)]


BUCKETS = 1000


def _number(column: Column, kind: T.DataType) -> Column | None:
    """A number that never falls where a column rises: its value, the first bytes of a text, that of a struct's first field."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp").cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double") if isinstance(kind, T.NumericType) else column.cast("int").cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.StructType) and kind.fields:
        return _number(column.getField(kind.fields[0].name), kind.fields[0].dataType)
    return None


def range_bucket(df: DataFrame, order: str) -> Column:
    """A number from 0 to BUCKETS for each row that never falls where a column rises, from approximate percentiles; null is -1.

    Rows of one value share a bucket, so do texts of equal first bytes and structs of equal first fields; arrays and maps
    have one bucket, 0. Percentiles are bounded in number and only place the edges, so results don't depend on how exact
    they are; they are found at once, as every use of the buckets must see the same edges.
    """
    number = _number(F.col(order), df.schema[order].dataType)
    steps = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    edges = np.unique(df.agg(F.percentile_approx(number, steps, 10 * BUCKETS)).first()[0] or []) if number is not None else []
    if not len(edges):
        return F.lit(0)

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(), "left").astype(np.int32))

    return F.when(number.isNull(), -1).otherwise(bucket(number))


def running_total(df: DataFrame, group: str | None, order: str, size: str, name: str) -> DataFrame:
    """df and, as `name`, the sum of the sizes that come before a row in its group, in two steps.

    Sums of range buckets are added up first, at most BUCKETS + 2 a group; then a window runs inside each bucket, so no
    task holds a whole group.
    """
    keys = [group] if group else []
    rows = df.withColumn("_bucket", range_bucket(df, order))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias("_group") for k in keys], F.col("_bucket").alias("_place"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_bucket") == F.col("_place")
    if group:
        same &= F.col(group).eqNullSafe(F.col("_group"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, same).withColumn(name, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).select(*df.columns, name)


def quartile_limit(df: DataFrame, value: Column, coefficient: float = 1.5) -> DataFrame:
    """q25, q75, bound and the largest value up to the bound of upper quartile + coefficient * interquartile range.

    A quartile is the first whole value whose cumulative count exceeds a quarter or three quarters of all. Cumulative counts
    run over the distinct values, bucket by bucket.
    """
    counts = df.select(value.cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    run = running_total(counts, None, "v", "n", "before").crossJoin(F.broadcast(total)).withColumn("below", F.col("before") + F.col("n"))
    q = run.agg(
        F.min(F.when(F.col("below") * 4 > F.col("total"), F.col("v"))).alias("q25"),
        F.min(F.when(F.col("below") * 4 > F.col("total") * 3, F.col("v"))).alias("q75"),
    ).withColumn("bound", F.col("q75") + coefficient * (F.col("q75") - F.col("q25")))
    return counts.join(F.broadcast(q), counts["v"] <= q["bound"]).groupBy("q25", "q75", "bound").agg(F.max("v").alias("limit"))


def letter_histogram(df: DataFrame, text: Column) -> DataFrame:
    """letter, n over all characters of the texts. Each text is counted before anything is shuffled: a row for each letter it has."""
    letters = df.select(text.alias("t")).select("t", F.explode(F.array_distinct(F.split("t", ""))).alias("letter")).where("letter <> ''")
    counted = letters.select("letter", (F.length("t") - F.length(F.replace(F.col("t"), F.col("letter"), F.lit("")))).cast("long").alias("k"))
    return counted.groupBy("letter").agg(F.sum("k").alias("n"))


def byte_histogram(df: DataFrame, value: Column) -> DataFrame:
    """bin, n for the 256 values of a byte."""
    return histogram(df, value, 0, 255)


def best_of_group(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The best row of each group, the first in order on a tie; one partial aggregate, no sort."""
    key = F.struct(F.col(score), (-F.col(order)).alias("_o"), F.struct(*df.columns).alias("_row"))
    return df.groupBy(group).agg(F.max(key).alias("_b")).select("_b._row.*")


def state_counts(df: DataFrame, state: Column) -> DataFrame:
    """state, n; states other than T, P, N and F count as a question mark."""
    return df.select(F.when(state.isin("T", "P", "N", "F"), state).otherwise("?").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def matrix_extrema(cells: DataFrame, key: str = "seq_id") -> DataFrame:
    """The least and greatest score of each state of each matrix."""
    return cells.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in ("match", "insertion", "deletion") for f, n in ((F.min, "min"), (F.max, "max"))])


def matrix_sum(cells: DataFrame, mirrored: DataFrame, length: int, key: str = "seq_id") -> DataFrame:
    """Cells plus those of the reversed sequence and profile at the mirrored place."""
    last = mirrored.groupBy(key).agg(F.max("seq").alias("_n"))
    other = mirrored.join(last, key).select(key, (F.col("_n") - F.col("seq")).alias("seq"), (length - F.col("prf")).alias("prf"), *[F.col(c).alias("_" + c) for c in ("match", "insertion", "deletion")])
    return cells.join(other, [key, "seq", "prf"]).select(key, "seq", "prf", *[(F.col(c) + F.col("_" + c)).alias(c) for c in ("match", "insertion", "deletion")])
