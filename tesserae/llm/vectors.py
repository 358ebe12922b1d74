"""Vectors as packed doubles, shared by the two operators on embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Not null, not empty, every component a finite number, and not all zero."""
    inf = F.lit(float("inf"))
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
    some = F.exists(column, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(good & some, F.lit(False))


def widths(vectors: DataFrame, column: str) -> list[int]:
    """The lengths that usable vectors have, in order."""
    return [r["w"] for r in vectors.where(usable(F.col(column))).select(F.size(column).alias("w")).distinct().orderBy("w").collect()]
