"""Product codes of vectors by Lloyd's rounds with Elkan's bounds, all in whole numbers.

A component x becomes floor(1024 * x); vectors are cut into equal parts, and each part position has a codebook that
starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to the componentwise floor of its parts' mean.

Between rounds each row keeps, for each part, an upper bound of the distance to its entry and one lower bound of the
distance to every entry. When entries move, the upper bound grows by the movement of the own entry and each lower bound
shrinks by that of its entry. An entry is passed over only if the triangle inequality proves it strictly farther: the
upper bound is below its lower bound, or twice the upper bound is below the distance between the two entries. Whatever
is left, ties included, is settled by exact distances of whole numbers. Bounds are whole numbers too (upper ones rounded
up, lower ones down), so no rounding can hide an entry; lower bounds are stored in a byte each, with a shift per part,
rounded down.

State lies in a table of the shared folder, one for each round; the one before is deleted once the next is whole. Sums
of the entries come from the rows whose code changed, added up in each task before the shuffle; entries and sums, whose
number does not depend on the rows, are all that reaches the driver. Rows never meet each other but for the sum of a
label, which is taken before the shuffle; labels with more than a thousandth of the rows, at most 1,000, are joined by
broadcast, the others by a shuffle.

Vectors that are null or hold null or non-finite components are dropped. Null ids come last in the order of ids, equal
ids are told apart by their vectors; repeated rows are rows of their own. With fewer rows than entries the codebooks
are shorter; unused entries stay. The length that counts is that of the vector with the smallest id and must be a
multiple of the number of parts; a vector of another length stays in the result with null code, error and label_error.
Components must lie within 2**17 on either side, so that errors fit a long; larger ones raise an error. An empty table
gives an empty result. Null labels are one label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import new_dir

SCALE, LARGEST = 1024, 1 << 27
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK = 2048  # rows at once
STATE = "vec_id long, label {label}, ints binary, code binary, old binary, upper binary, lower binary, changed boolean"


def finite(column: Column) -> Column:
    """Not null, and every component a finite number."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))), F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles."""
    out = np.floor(values.astype(np.float64) * SCALE)
    if len(out) and np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError("a component is too large")
    return out.astype(np.int64)


def root(squares: np.ndarray) -> np.ndarray:
    """The floor of the square root of whole numbers."""
    out = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    out -= out * out > squares
    return out + ((out + 1) * (out + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    out = root(squares)
    return out + (out * out < squares)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if float(most) * float(most) * max(x.shape[1], 1) < 2**51:  # products of doubles are exact
        dot = (x.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * dot
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


@dataclass
class Books:
    """The entries of each part and what moving there took: the bounds' shifts and the entries' distances, rounded."""

    entries: np.ndarray  # part x entry x position
    moved: np.ndarray | None = None  # part x entry, rounded up

    def __post_init__(self) -> None:
        self.apart = np.stack([root(squared(own, own)) for own in self.entries]) if len(self.entries) else None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blob(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    size = rows.shape[1] * rows.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The array that binary values of equal size hold."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    size = width * np.dtype(kind).itemsize
    return data[start : start + size * len(column)].view(np.uint8).reshape(len(column), size).copy().view(kind).reshape(len(column), width)


def _packed(lower: np.ndarray) -> np.ndarray:
    """Lower bounds of a part's entries in a byte each, rounded down, after the shift they share."""
    most = lower.max(axis=1, initial=0)
    shift = np.zeros(len(lower), np.int64)
    while (far := most >> shift > 255).any():
        shift += far
    return np.concatenate([shift[:, None], lower >> shift[:, None]], axis=1).astype(np.uint8)


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return packed[:, 1:].astype(np.int32) << packed[:, :1].astype(np.int32)


def first_bounds(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, upper bound, lower bounds) of parts that have none yet."""
    d = squared(x, entries)
    code = d.argmin(axis=1)
    least = d[np.arange(len(x)), code]
    return code, least, root_up(least), root(d)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Books, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper bound, lower bounds, exact distances taken) after the entries moved; the arguments are of before."""
    entries, apart, moved = books.entries[part], books.apart[part], books.moved[part]
    upper, lower, code = upper + moved[code], np.maximum(lower - moved.astype(np.int32), 0), code.copy()
    every = np.arange(len(x))

    def left(rows: np.ndarray) -> np.ndarray:
        """Entries that no inequality proves strictly farther than the own one."""
        u = upper[rows][:, None]
        out = (u >= lower[rows]) & (2 * u >= apart[code[rows]])
        out[np.arange(len(rows)), code[rows]] = False
        return out

    some = np.flatnonzero(left(every).any(axis=1))
    own = ((x[some] - entries[code[some]]) ** 2).sum(axis=1)
    upper[some], taken = root_up(own), len(some)
    lower[some, code[some]] = root(own)
    open_ = left(some)
    rest = open_.any(axis=1)
    some, own, open_ = some[rest], own[rest], open_[rest]
    if not len(some):
        return code, upper, lower, taken
    taken += int(open_.sum())
    if open_.mean() > 0.06:  # many entries are left: one product for all, the passed ones are not looked at
        d = squared(x[some], entries)
        lower[some] = np.where(open_, root(d), lower[some])
        d[~open_] = np.iinfo(np.int64).max
    else:
        r, c = np.nonzero(open_)
        d = np.full(open_.shape, np.iinfo(np.int64).max)
        d[r, c] = ((x[some[r]] - entries[c]) ** 2).sum(axis=1)
        lower[some[r], c] = root(d[r, c])
    d[np.arange(len(some)), code[some]] = own
    code[some] = d.argmin(axis=1)  # the first of equal ones
    upper[some] = root_up(d[np.arange(len(some)), code[some]])
    return code, upper, lower, taken


def _starter(books: Books, label: pa.DataType):
    """Rows of vectors to state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        for big in batches:
            for at in range(0, len(big), BLOCK):
                batch = big.slice(at, BLOCK)
                x = whole(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), parts * width))
                found = [first_bounds(x[:, p * width : (p + 1) * width], books.entries[p]) for p in range(parts)]
                yield _state(batch.column(0), batch.column(1), x, found, np.zeros((len(batch), parts), np.uint8), True)

    return run


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, found: list[tuple], old: np.ndarray, first: bool) -> pa.RecordBatch:
    code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
    upper = np.stack([f[-2] for f in found], axis=1).astype("<i4")
    lower = np.concatenate([_packed(f[-1]) for f in found], axis=1)
    small = np.abs(x).max(initial=0) < 1 << 15
    changed = pa.array(np.full(len(x), True) if first else (code != old).any(axis=1))
    columns = [ids, labels, _blob(x.astype("<i2" if small else "<i4")), _blob(code), _blob(old), _blob(upper), _blob(lower), changed]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "ints", "code", "old", "upper", "lower", "changed"])


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """The whole numbers of rows, stored in two or four bytes each."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    out = np.zeros((len(column), width), np.int64)
    for kind in ("<i2", "<i4") if width else ():
        own = np.flatnonzero(size == width * np.dtype(kind).itemsize)
        if len(own) == len(column):
            return _rows(column, kind, width).astype(np.int64)
        if len(own):
            out[own] = _rows(column.take(pa.array(own)), kind, width)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, len(big), BLOCK):
            yield big.slice(at, BLOCK)


def _reassigned(batch: pa.RecordBatch, books: Books) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(whole numbers, codes before, what `assign` finds for each part) of rows of state."""
    parts, entries, width = books.entries.shape
    x = _ints(batch.column("ints"), parts * width)
    old = _rows(batch.column("code"), "u1", parts)
    upper = _rows(batch.column("upper"), "<i4", parts).astype(np.int64)
    lower = _rows(batch.column("lower"), "u1", parts * (entries + 1))
    found = []
    for p in range(parts):
        own = lower[:, p * (entries + 1) : (p + 1) * (entries + 1)]
        found.append(assign(x[:, p * width : (p + 1) * width], old[:, p].astype(np.int64), upper[:, p], _unpacked(own), books, p))
    return x, old, found


def _stepper(books: Books):
    """State to the state of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            x, old, found = _reassigned(batch, books)
            yield _state(batch.column("vec_id"), batch.column("label"), x, [(c, u, low) for c, u, low, _ in found], old, False)

    return run


def _finisher(books: Books):
    """State to codes and their exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for batch in _blocks(batches):
            x, _, found = _reassigned(batch, books)
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(((x[:, p * width : (p + 1) * width] - books.entries[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
            names = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _summer(parts: int, entries: int, width: int, first: bool):
    """Changes of the entries' sums: (cell, value), the count of an entry in cell 0 and its components after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in _blocks(batches):
            x = _ints(batch.column("ints"), parts * width)
            code, old = (_rows(batch.column(c), "u1", parts).astype(np.int64) for c in ("code", "old"))
            for p in range(parts):
                own = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]], axis=1)
                apply = np.arange(len(x)) if first else np.flatnonzero(code[:, p] != old[:, p])
                np.add.at(total[p], code[apply, p], own[apply])
                if not first:
                    np.subtract.at(total[p], old[apply, p], own[apply])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total.ravel()[cell], pa.int64())], names=["cell", "value"])

    return run


def _delete(df: DataFrame, path: str) -> None:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _moved(books: Books, sums: np.ndarray) -> Books:
    """The books after each used entry went to the floor of its parts' mean."""
    count = sums[..., 0]
    entries = np.where(count[..., None] > 0, sums[..., 1:] // np.maximum(count, 1)[..., None], books.entries)
    return Books(entries, root_up(((entries - books.entries) ** 2).sum(axis=-1)))


@dataclass
class Codes:
    """codes: vec_id, label, code, error of every kept row; books: the final entries; others: rows of other lengths."""

    codes: DataFrame
    books: Books
    rows: int
    others: DataFrame


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes | None:
    """Codebooks and codes after so many rounds and a last assignment; None where no row is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = own.where(finite(F.col("v")))
    start = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        return None
    length = len(start[0]["v"])
    if length % parts:
        raise ValueError(f"{length} components do not make {parts} equal parts")
    first = np.stack([whole(np.array(r["v"], np.float64)) for r in start if len(r["v"]) == length])
    books = Books(np.ascontiguousarray(first.reshape(len(first), parts, length // parts).transpose(1, 0, 2)))
    shape = (parts, len(first), length // parts)
    kind = own.schema["label"].dataType
    schema = STATE.format(label=kind.simpleString())
    state = kept.where(F.size("v") == length).mapInArrow(_starter(books, kind), schema)
    sums, path, rows = np.zeros((parts, len(first), 1 + length // parts), object), None, 0
    for r in range(rounds):
        new = new_dir(spark, f"elkan-{r}")
        state.write.option("compression", "zstd").parquet(new)
        saved = spark.read.schema(schema).parquet(new)
        if path:
            _delete(saved, path)
        path = new
        changes = saved.where("changed").select("ints", "code", "old").mapInArrow(_summer(*shape, r == 0), "cell long, value long")
        for cell, value in changes.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # at most the cells of the books
            sums[np.unravel_index(cell, sums.shape)] += value
        rows = int(sums[0, :, 0].sum())
        books = _moved(books, sums.astype(np.int64))
        state = saved.mapInArrow(_stepper(books) if r < rounds - 1 else _finisher(books), schema if r < rounds - 1 else f"vec_id long, label {kind.simpleString()}, code string, error long")
    new = new_dir(spark, "codes")
    state.write.parquet(new)
    _delete(saved, path)
    return Codes(spark.read.schema(state.schema).parquet(new), books, rows, kept.where(F.size("v") != length).select("vec_id", "label"))


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors of the label summed), codebooks_sha256."""
    found = train(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    codes, digest = found.codes, F.lit(found.books.digest())
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    named = totals.withColumnRenamed("label", "_label")
    often = named.where(F.col("_n") > found.rows / 1000)  # 1,000 labels at most
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = codes.join(F.broadcast(often), same, "left")
    done = hot.where(F.col("_n").isNotNull())
    rest = hot.where(F.col("_n").isNull()).drop("_label", "_n", "label_error").join(named.where(F.col("_n") <= found.rows / 1000), same)
    out = [df.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256")) for df in (done, rest)]
    null = found.others.select("vec_id", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")], digest.alias("codebooks_sha256"))
    return out[0].unionByName(out[1]).unionByName(null)
