"""Reading sequences: FASTA text in batch and as a stream, format sniffing, random data and score sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import MAP_SCORES

#: The first bytes of the known formats.
MAGIC = [("hdf5", bytes([0x89]) + b"HDF"), ("bam", bytes([0x1F, 0x8B, 0x08, 0x04]))]


def _records(value: Column) -> list[Column]:
    """header and raw of a record without its >."""
    cut = F.instr(value, "\n")
    raw = F.when(cut > 0, F.substring(value, cut + 1, F.length(value))).otherwise("")
    return [F.regexp_replace(F.substring_index(value, "\n", 1), r"\r$", "").alias("header"), raw.alias("raw")]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of FASTA files cut before each >, as value, file, start of the split and more columns.

    A task reads its splits one after the other, so the first piece of a file is the first of a split that starts at 0,
    where another file or another split came before. It still has its >, or is left out if it has none; other pieces
    have lost their >.
    """
    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.StructArray.from_arrays([batch.column(1), batch.column(2)], ["file", "start"])
        new = pc.fill_null(pc.or_(pc.not_equal(batch.column(1)[1:], batch.column(1)[:-1]), pc.not_equal(batch.column(2)[1:], batch.column(2)[:-1])), True)
        at = [i + 1 for i in np.flatnonzero(new.to_numpy(zero_copy_only=False)).tolist()]
        at = ([0] if (here[0]["file"].as_py(), here[0]["start"].as_py()) != last else []) + at
        last = (here[-1]["file"].as_py(), here[-1]["start"].as_py())
        values, keep = batch.column(0), np.ones(batch.num_rows, bool)
        changed = {}
        for i in at:
            if here[i]["start"].as_py() == 0:
                text = values[i].as_py().lstrip(" \t\r\n")
                keep[i] = text.startswith(">")
                changed[i] = text[1:]
        if changed:
            parts, edge = [], 0
            for i, text in changed.items():
                parts += [values.slice(edge, i - edge), pa.array([text], values.type)]
                edge = i + 1
            values = pa.concat_arrays([*parts, values.slice(edge)])
        columns = [values, *[batch.column(i) for i in range(1, batch.num_columns)]]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))


def _placed() -> list[Column]:
    return [F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, header, raw of each record. Files are split between records, so one large file is many tasks.

    seq_id follows the order in the files but has gaps between their splits. Text before a file's first > is left out.
    """
    rows = spark.read.option("lineSep", "\n>").text(path)
    rows = rows.select(*_placed(), F.monotonically_increasing_id().alias("seq_id"))
    return rows.mapInArrow(_heads, rows.schema).select("seq_id", *_records(F.col("value")))


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The records of the FASTA files that come into a folder: header, raw. Stateless; files bound a micro-batch.

    Text before a file's first > is left out.
    """
    rows = spark.readStream.schema("value string").option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    rows = rows.select(*_placed())
    return rows.mapInArrow(_heads, rows.schema).select(*_records(F.col("value")))


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """path, format of files by their first bytes: fasta, hdf5, bam or unknown. Only 64 bytes of a file are read."""
    names = spark.read.format("binaryFile").load(path).select("path")  # the content is never read

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            kinds = []
            for name in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with system.open_input_file(place) as f:
                    head = f.read(64)
                kinds.append("fasta" if head.lstrip().startswith(b">") else next((kind for kind, magic in MAGIC if head.startswith(magic)), "unknown"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["path", "format"])

    return names.mapInArrow(heads, "path string, format string")


def random_sequences(spark: SparkSession, count: int, length: int, suffix: int = 0, seed: int = 1) -> DataFrame:
    """seq_id, header, raw: random bases and then `suffix` copies of CAG; the same rows for the same seed."""
    base = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)) + 1).cast("int"), F.lit(1))
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "") if length else F.lit("")
    return spark.range(count).select(F.col("id").alias("seq_id"), F.concat(F.lit("random_"), F.col("id")).alias("header"), F.concat(letters, F.lit("CAG" * suffix)).alias("raw"))


def load_scores(text: str) -> dict:
    """Mapping scores from JSON; parts that are left out keep their defaults."""
    given = json.loads(text)
    unknown = set(given) - set(MAP_SCORES)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")
    return {k: {**v, **{n: int(x) for n, x in given.get(k, {}).items()}} for k, v in MAP_SCORES.items()}


def dump_scores(scores: dict = MAP_SCORES) -> str:
    """Mapping scores as JSON."""
    return json.dumps(scores, indent=1)
