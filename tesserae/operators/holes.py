"""Sequencing holes: selection, regions, pulses, traces and stitching, over the table zmw.

zmw: hole, x, y, status, bases and regions, an array of (type, start, stop, quality).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import running_total

ZMW = "hole int, x smallint, y smallint, status tinyint, bases string, regions array<struct<type:string,start:int,stop:int,quality:int>>"
HQ_QUALITY = 750


def high_quality(regions: Column) -> Column:
    """The last HQRegion, or null."""
    return F.try_element_at(F.filter(regions, lambda r: r["type"] == "HQRegion"), F.lit(-1))


def clip_to_high_quality(zmw: DataFrame) -> DataFrame:
    """Inserts cut to the last HQRegion, empty ones as Useless, and hq_length."""
    hq = high_quality(F.col("regions"))

    def cut(r: Column) -> Column:
        start, stop = F.greatest(r["start"], F.col("_hq.start")), F.least(r["stop"], F.col("_hq.stop"))
        inside = F.struct(F.when(stop > start, r["type"]).otherwise("Useless").alias("type"), start.alias("start"), stop.alias("stop"), r["quality"].alias("quality"))
        return F.when((r["type"] == "Insert") & F.col("_hq").isNotNull(), inside).otherwise(r)

    out = zmw.withColumn("_hq", hq).withColumn("regions", F.transform("regions", cut))
    return out.withColumn("hq_length", F.coalesce(F.col("_hq.stop") - F.col("_hq.start"), F.lit(0))).drop("_hq")


def select(zmw: DataFrame, sequencing_only: bool = True, number: int | None = None, invalid: str = "drop", min_quality: int = 0, max_quality: int = 1000, white_list: DataFrame | None = None) -> DataFrame:
    """Holes by status, number, validity of their HQRegion (drop, keep or only invalid ones), its quality and a list."""
    hq = high_quality(F.col("regions"))
    valid = F.coalesce((hq["stop"] > 0) & (hq["stop"] > hq["start"]), F.lit(False))
    out = zmw.where("status = 0") if sequencing_only else zmw
    out = out if number is None else out.where(F.col("hole") == number)
    out = {"drop": lambda d: d.where(valid), "only": lambda d: d.where(~valid), "keep": lambda d: d}[invalid](out)
    out = out.where(~valid | hq["quality"].between(min_quality, max_quality))
    return out if white_list is None else out.join(white_list.select("hole").distinct(), "hole", "left_semi")


def subreads(zmw: DataFrame, least: int = 2) -> DataFrame:
    """hole, region, start, stop, bases of the inserts that are at least so long."""
    flat = zmw.select("hole", "bases", F.posexplode("regions").alias("region", "r")).where("r.type = 'Insert'")
    flat = flat.where(F.col("r.stop") - F.col("r.start") >= least)
    return flat.select("hole", "region", "r.start", "r.stop", F.substring(F.col("bases"), F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")).alias("bases"))


def stitch(parts: DataFrame, key: str = "hole", order: str = "start", text: str = "bases") -> DataFrame:
    """One read of each group: its parts in order, joined. A group is one molecule's reads, which are few."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias(text))


def stitch_sources(reads: DataFrame, fill: str = "N", status: str = "zmw_type") -> DataFrame:
    """The table zmw from subreads and scraps beside each other: rows of hole, start, stop, kind, bases, accuracy, zmw_type.

    The parts of a hole follow each other by start; `fill` stands for bases between them that no row has, and bases that
    an earlier part already gave are not repeated. Every part with a kind is a region, Insert for subreads. The region of
    high quality comes from those of low quality: all if there is none; what one leaves at either end (none if it leaves
    both); of more, every gap before one of them. Its quality is the first accuracy given. status is 0 if no zmw_type
    says otherwise than N. A hole's reads are few and meet in one row; parts with a null hole, start or stop are left out.
    """
    own = reads.where("hole is not null and start is not null and stop is not null")
    part = F.struct("start", "stop", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("bases", F.lit("")).alias("bases"), "accuracy", F.col(status).alias("type"))
    rows = own.groupBy("hole").agg(F.sort_array(F.collect_list(part)).alias("p"))
    first = F.col("p")[0]["start"]
    zero = F.struct(first.alias("at"), F.lit("").alias("text"))

    def grow(a: Column, x: Column) -> Column:
        new = F.concat(F.repeat(F.lit(fill), F.greatest(x["start"] - a["at"], F.lit(0))), F.substring(x["bases"], F.greatest(a["at"] - x["start"], F.lit(0)) + 1, F.length(x["bases"])))
        return F.struct(F.greatest(a["at"], x["stop"]).alias("at"), F.concat(a["text"], new).alias("text"))

    region = lambda kind, a, b, q: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), a.alias("start"), b.alias("stop"), q.alias("quality"))
    rows = rows.withColumn("_text", F.aggregate("p", zero, grow, lambda a: a["text"])).withColumn("_end", F.array_max(F.transform("p", lambda x: x["stop"])))
    rows = rows.withColumn("_low", F.filter("p", lambda x: x["kind"] == "LQRegion")).withColumn("_q", F.coalesce(F.filter("p", lambda x: x["accuracy"].isNotNull())[0]["accuracy"], F.lit(0)))
    low = F.col("_low")
    every = region("HQRegion", first, F.col("_end"), F.col("_q"))
    one = F.when(low[0]["start"] == first, F.array(region("HQRegion", low[0]["stop"], F.col("_end"), F.col("_q")))).when(low[0]["stop"] == F.col("_end"), F.array(region("HQRegion", first, low[0]["start"], F.col("_q"))))
    gaps = F.transform(low, lambda x, i: region("HQRegion", F.when(i == 0, first).otherwise(low[F.greatest(i - 1, F.lit(0))]["stop"]), x["start"], F.col("_q")))
    high = F.when(F.size(low) == 0, F.array(every)).when(F.size(low) == 1, F.coalesce(one, F.slice(F.array(every), 1, 0))).otherwise(F.filter(gaps, lambda g: g["stop"] > g["start"]))
    others = F.transform(F.filter("p", lambda x: x["kind"] != ""), lambda x: region(x["kind"], x["start"], x["stop"], F.lit(0)))
    regions = F.concat(others, high)
    shifted = F.transform(regions, lambda r: region(r["type"], r["start"] - first, r["stop"] - first, r["quality"]))
    normal = F.forall("p", lambda x: F.coalesce(x["type"] == "N", F.lit(True)))
    return rows.select("hole", F.shiftright("hole", 16).cast("smallint").alias("x"), F.col("hole").bitwiseAND(0xFFFF).cast("int").alias("y"), F.when(normal, 0).otherwise(1).cast("tinyint").alias("status"), F.col("_text").alias("bases"), shifted.alias("regions"))


def region_listing(zmw: DataFrame) -> DataFrame:
    """hole, region, type, start, stop, quality: a line for each region of each hole, in order."""
    flat = zmw.select("hole", F.posexplode("regions").alias("region", "r"))
    return flat.select("hole", "region", "r.type", "r.start", "r.stop", "r.quality")


def running_offset(df: DataFrame, group: str | None, order: str, size: str) -> DataFrame:
    """offset: the sizes that come before a row in its group."""
    return running_total(df, group, order, size, "offset")


def pulses(pre: Column, width: Column) -> Column:
    """(start, end) frames of base calls: a start is the last end plus the frames before, an end adds the width."""
    steps = F.arrays_zip(pre.alias("pre"), width.alias("width"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    grow = lambda a, s: F.struct((a["at"] + s["pre"] + s["width"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["pre"]).alias("start"), (a["at"] + s["pre"] + s["width"]).alias("end")))).alias("out"))
    return F.aggregate(steps, zero, grow, lambda a: a["out"])


def decode_trace(codes: Column, table: list[int], bias: int) -> Column:
    """Trace values of code bytes: a table's entries less a bias."""
    values = F.array(*[F.lit(v) for v in table])
    return F.transform(codes, lambda c: values[c] - bias)


def summary(zmw: DataFrame, threshold: int = HQ_QUALITY) -> DataFrame:
    """Counts of holes by status and quality, and of subreads within and outside their high-quality region."""
    hq = high_quality(F.col("regions"))
    valid = F.coalesce(hq["stop"] > hq["start"], F.lit(False))
    inserts = F.filter("regions", lambda r: r["type"] == "Insert")
    within = F.size(F.filter(inserts, lambda r: F.coalesce((r["start"] < hq["stop"]) & (r["stop"] > hq["start"]), F.lit(False))))
    rows = zmw.select((F.col("status") == 0).alias("s"), valid.alias("v"), hq["quality"].alias("q"), F.size(inserts).alias("n"), within.alias("w"))
    return rows.agg(
        F.count("*").alias("holes"),
        F.count_if("s").alias("sequencing"),
        F.count_if(F.col("s") & F.col("v") & (F.col("q") >= threshold)).alias("high_quality"),
        F.count_if(F.col("s") & F.col("v") & (F.col("q") < threshold)).alias("low_quality"),
        F.count_if(F.col("s") & ~F.col("v")).alias("invalid"),
        F.coalesce(F.sum(F.when(F.col("s"), F.col("n"))), F.lit(0)).alias("subreads"),
        F.coalesce(F.sum(F.when(F.col("s"), F.col("w"))), F.lit(0)).alias("within"),
        F.coalesce(F.sum(F.when(F.col("s"), F.col("n") - F.col("w"))), F.lit(0)).alias("outside"),
        F.count_if(~F.col("s")).alias("other"),
    )


def hole_rows(zmw: DataFrame) -> DataFrame:
    """hole, x, y, quality, hq_length, length, subreads: one line of each hole."""
    hq = high_quality(F.col("regions"))
    inserts = F.size(F.filter("regions", lambda r: r["type"] == "Insert"))
    return zmw.select("hole", "x", "y", F.coalesce(hq["quality"], F.lit(0)).alias("quality"), F.coalesce(hq["stop"] - hq["start"], F.lit(0)).alias("hq_length"), F.length("bases").alias("length"), inserts.alias("subreads"))


def best_subread(scores: DataFrame, score: str = "score") -> DataFrame:
    """The best-scoring region of each hole, the first on a tie."""
    key = F.struct(F.col(score), (-F.col("region")).alias("r"), F.struct(*scores.columns).alias("row"))
    return scores.groupBy("hole").agg(F.max(key).alias("b")).select("b.row.*")
