"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bm25_packing, crf_quality, mixing, odd_sketch, sentence_spans
from tesserae.llm.scratch import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go; without any labels none does."""
    return crf_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without an id stay.

    Null, empty and very long texts, repeated rows and ties are as `odd_sketch` says; columns may have any names.
    """
    gone = odd_sketch.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars follows the text. Null ids and texts stay as they are."""
    cut = sentence_spans.dedup_passages(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes the document; null and empty texts, of size 0, are taken as any other."""
    taken = mixing.mix(docs.select(*docs.columns), keep=docs.columns)
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = taken.toDF(*["_id", "_size", "_source_size", "_target", "_taken", "_copies", *names])
    return own.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_copies")))).where("_n > 0").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences; a repeated row is a document of its own."""
    return bm25_packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
