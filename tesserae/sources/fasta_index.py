"""An index of FASTA files: where each record lies, so that some of them can be read without the others.

One pass over ranges of the files finds the records that start in each; a record's end is looked for beyond the range
if need be. Numbers follow the names of the files and the places in them, whatever the ranges. The index is a table: it
is kept as Parquet, and reading it back checks that the files still have the sizes they had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import BLOCK, file_ranges, open_file

BUFFER = 1 << 20
FOUND = "file string, size long, start long, place int, name string, offset long, length long"
INDEX = "seq_id long, file string, size long, name string, offset long, length long"


def _starts(source, start: int, stop: int, size: int) -> Iterator[tuple[int, bool]]:
    """(place of each > that starts a record, whether it is the range's own), up to the first after the range or the file's end."""
    at, before = start, b"\n"
    if start:
        source.seek(start - 1)
        before = source.read(1)
    source.seek(start)
    leading = start == 0
    while at < size:
        data = source.read(BUFFER)
        if not data:
            break
        text, shift = before + data, at - len(before)
        rest = data.lstrip(b" \t\r\n")
        if leading and rest:  # blanks may come before the first record, whose range is the file's first
            leading, k = False, len(text) - len(rest)
            if rest.startswith(b">") and text[k - 1 : k] != b"\n":
                yield shift + k, True
        i = text.find(b"\n>")
        while i >= 0:
            here = shift + i + 1
            yield here, here < stop
            if here >= stop:
                return
            i = text.find(b"\n>", i + 1)
        at += len(data)
        before = data[-1:]
    yield size, False


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = open_file(row["file"])
            with system.open_input_file(place) as source:
                starts = list(_starts(source, row["start"], row["stop"], row["size"]))
                records = [(a, b - a) for (a, own), (b, _) in zip(starts, starts[1:], strict=False) if own]
                names = []
                for offset, length in records:
                    source.seek(offset)
                    head = source.read(min(length, 512)).split(b"\n", 1)[0]
                    names.append(head[1:].split(b" ", 1)[0].rstrip(b"\r").decode(errors="replace"))
            n = len(records)
            columns = [[row["file"]] * n, [row["size"]] * n, [row["start"]] * n, list(range(n)), names, [r[0] for r in records], [r[1] for r in records]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def index_fasta(spark: SparkSession, path: str | list[str], block: int = BLOCK) -> DataFrame:
    """seq_id (from 0, without gaps), file, size, name (the header up to its first blank), offset, length of each record.

    The window that adds up counts runs over one row a range, not over the records.
    """
    found = file_ranges(spark, path, block).mapInArrow(_scan, FOUND)
    counts = found.groupBy("file", "start").agg(F.count("*").alias("_n"))
    base = counts.select(F.col("file").alias("_f"), F.col("start").alias("_s"), (F.sum("_n").over(Window.orderBy("file", "start")) - F.col("_n")).alias("_base"))
    rows = found.join(base, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")))
    return rows.select((F.col("_base") + F.col("place")).alias("seq_id"), "file", "size", "name", "offset", "length")


def write_index(index: DataFrame, path: str) -> None:
    """Keep an index, in the order of its records."""
    index.repartitionByRange("seq_id").sortWithinPartitions("seq_id").write.parquet(path)


def read_index(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A kept index; check: fails where a file no longer has the size it had."""
    index = spark.read.schema(INDEX).parquet(path)
    if check:
        names = [r["file"] for r in index.select("file").distinct().collect()]  # one a file, as a listing has
        if names:
            now = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), F.col("length").alias("_now"))
            old = index.select("file", "size").distinct().join(now, "file", "left").where(~F.col("size").eqNullSafe(F.col("_now"))).first()
            if old:
                raise ValueError(f"{old['file']} changed since it was indexed")
    return index


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, source = None, None
    for batch in batches:
        heads, texts = [], []
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            if file != opened:
                system, place = open_file(file)
                source, opened = system.open_input_file(place), file
            source.seek(offset)
            head, _, text = source.read(length)[1:].partition(b"\n")
            heads.append(head.rstrip(b"\r").decode(errors="replace"))
            texts.append(text.decode(errors="replace").removesuffix("\n"))
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(heads, pa.string()), pa.array(texts, pa.string())], names=["seq_id", "header", "raw"])


def read_records(rows: DataFrame) -> DataFrame:
    """seq_id, header, raw of rows of an index, one range of bytes each, in order of place within a task."""
    return rows.select("file", "offset", "length", "seq_id").sortWithinPartitions("file", "offset").mapInArrow(_read, "seq_id long, header string, raw string")
