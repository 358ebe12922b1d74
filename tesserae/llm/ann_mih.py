"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning: on a bounded sample the principal axes are rotated so that signs lose least (iterative quantisation); bits
beyond the dimension come from further seeded rotations. Codes are split into substrings of 16 bits.

Index: every row lies in one list per substring, keyed by (substring number, leading bits of its value); lists are cut
into blocks of about BLOCK_ROWS rows by a hash of the id, so a list that a third of all rows share is many tasks.

Search: a code within Hamming distance r of the query has, in some substring, a distance of at most that substring's
share of r (pigeonhole). A query goes to the lists whose leading bits allow that share; there the buckets within the
share are probed, codes are compared whole, and those within r are reranked by inner product in double precision. A
candidate counts only in the first substring that would find it, so no pair comes twice; each task returns at most k
rows a query.

The radius is calibrated: exact neighbours of CALIBRATION queries, found by brute force over all rows, must lie within
it with TARGET recall. Queries that find fewer than k rows search again with every code in reach, so a result is short
only if there are fewer candidates. The query set is stated: it grows with the table and meets blocks of rows.

Rows: k a query, ties to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part;
null ids neither. Vectors of different lengths have no inner product: each length is searched on its own, with its own
codes. Every row is a candidate, those that repeat an id too; rows that repeat id and vector travel as one row with their
number, and their query is answered once, with that number as query_rows. Its own row is one of them; the others are its
candidates. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import save
from .vectors import usable, widths

K = 20
BITS = 64  # four substrings of 16
SAMPLE, ROUNDS = 8192, 30
CALIBRATION, TARGET = 128, 0.975
BLOCK_ROWS = 32768
SEED = 11

FOUND = "query_id long, query_hash long, vec_id long, score double"


class Coder:
    """Centred, rotated signs as unsigned 16-bit substrings; learned by iterative quantisation."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        x, d = sample - self.mean, sample.shape[1]
        blocks = []
        for first in range(0, bits, d):
            n = min(d, bits - first)
            _, axes = np.linalg.eigh(x.T @ x)
            v = x @ axes[:, ::-1][:, :n]
            r, _ = np.linalg.qr(rng.normal(size=(n, n)))
            for _ in range(ROUNDS if not first else 1):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            blocks.append(axes[:, ::-1][:, :n] @ (r if not first else np.linalg.qr(rng.normal(size=(n, n)))[0]))
        self.rotation = np.concatenate(blocks, axis=1)
        self.bits = bits

    def code(self, x: np.ndarray) -> np.ndarray:
        """Rows of bits / 16 unsigned 16-bit words."""
        on = ((x - self.mean) @ self.rotation >= 0).astype(np.uint8)
        return np.ascontiguousarray(np.packbits(on, axis=1)).view(np.uint16)


def shares(radius: int, parts: int) -> list[int]:
    """How far each substring must be probed so that every code within the radius is met; -1: not at all."""
    whole, rest = divmod(radius, parts)
    return [whole if i <= rest else whole - 1 for i in range(parts)]


def _codes(column: pd.Series) -> np.ndarray:
    """Codes that travelled as bytes."""
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so equal rows have equal scores."""
    return np.add.reduce(rows * query, axis=1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, in that order."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _probe(coder: Coder, radius: int, k: int):
    reach = shares(radius, coder.bits // 16)
    around = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(rows):
            part = int(key[0])
            x, q = _matrix(rows["vector"]), _matrix(queries["vector"])
            ids, code, asked = rows["vec_id"].to_numpy(), _codes(rows["code"]), _codes(queries["code"])
            mark, copies = rows["hash"].to_numpy(), rows["copies"].to_numpy()
            norm = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
            order = np.argsort(code[:, part], kind="stable")  # the index of this block: rows by substring value
            x, ids, code, mark, copies = x[order], ids[order], code[order], mark[order], copies[order]
            values, first = np.unique(code[:, part], return_index=True)
            size = np.diff(np.append(first, len(code)))
            whole, asked_whole, rough = code.view(np.uint64), asked.view(np.uint64), x.astype(np.float32)
            for i, (query_id, query_mark) in enumerate(zip(queries["query_id"].to_numpy(), queries["query_hash"].to_numpy(), strict=True)):
                at = np.flatnonzero(np.repeat(around[values ^ asked[i, part]] <= reach[part], size))
                at = at[np.bitwise_count(whole[at] ^ asked_whole[i]).sum(axis=1, dtype=np.uint16) <= radius]
                own = (ids[at] == query_id) & (mark[at] == query_mark)
                keep = ~own | (copies[at] > 1)
                for j in range(part):
                    keep &= np.bitwise_count(code[at, j] ^ asked[i, j]) > reach[j]
                at = at[keep]
                if len(at) > k:  # single precision first, with room for its error
                    near = rough[at] @ q[i].astype(np.float32)
                    at = at[near >= np.partition(near, -k)[-k] - 1e-4 * norm[i]]
                if len(at):
                    score = inner(x[at], q[i])
                    others = copies[at] - ((ids[at] == query_id) & (mark[at] == query_mark))
                    top = best(score, ids[at], k)
                    top = np.repeat(top, np.minimum(others[top], k))[:k]
                    out.append((np.full(len(top), query_id), np.full(len(top), query_mark), ids[at][top], score[top]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("query_id", "query_hash", "vec_id", "score"), columns, strict=True)))

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrate(rows: DataFrame, coder: Coder, k: int) -> int:
    """The radius within which TARGET of the exact neighbours of CALIBRATION queries lie."""
    spark = rows.sparkSession
    asked = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "hash").limit(CALIBRATION).toPandas()
    q, names, marks = _matrix(asked["vector"]), asked["vec_id"].to_numpy(), asked["hash"].to_numpy()
    given = spark.sparkContext.broadcast((q, names, marks, coder.code(q)))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, own_ids, own_marks, own_code = given.value
        for pdf in batches:
            x, ids, mark = _matrix(pdf["vector"]), pdf["vec_id"].to_numpy(), pdf["hash"].to_numpy()
            score, code = own @ x.T, coder.code(x)
            for i, name in enumerate(own_ids):
                at = np.flatnonzero((ids != name) | (mark != own_marks[i]))
                top = at[best(score[i, at], ids[at], k)]
                yield pd.DataFrame({"query_id": name, "query_hash": own_marks[i], "vec_id": ids[top], "score": score[i, top], "apart": np.bitwise_count(code[top] ^ own_code[i]).sum(axis=1).astype(np.int32)})

    near = _top(rows.mapInPandas(exact, FOUND + ", apart int"), k)
    by = sorted((r["apart"], r["count"]) for r in near.groupBy("apart").count().collect())
    total, seen = sum(n for _, n in by), 0
    for apart, n in by:
        seen += n
        if seen >= TARGET * total:
            return int(apart)
    return coder.bits


def _search(queries: DataFrame, rows: DataFrame, coder: Coder, radius: int, k: int, n_rows: int) -> DataFrame:
    """query_id, vec_id, score of at most k rows for each query and block."""
    reach = shares(radius, coder.bits // 16)
    parts = next((j + 1 for j, r in enumerate(reach) if r >= 16), len(reach))  # a part that allows all values finds every row
    lead = max(0, min(16, (max(n_rows, 1) // BLOCK_ROWS).bit_length()))

    @F.pandas_udf("binary")
    def coded(column: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in coder.code(_matrix(column))] if len(column) else [], dtype=object)

    @F.pandas_udf("array<int>")
    def leads(column: pd.Series) -> pd.Series:
        return pd.Series(list(_codes(column)[:, :parts].astype(np.int32) >> (16 - lead)) if len(column) else [], dtype=object)

    given = ["vec_id", "hash", "copies", "vector", "code"]
    index = rows.withColumn("code", coded("vector")).withColumn("leads", leads("code")).select(*given, F.posexplode("leads").alias("part", "lead"))
    # at most parts * 2**lead list sizes, which grow by one for BLOCK_ROWS rows and parts
    sizes = index.groupBy("part", "lead").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    blocks = save(sizes, "lists")
    index = index.join(blocks, ["part", "lead"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "hash"), "blocks"))
    sent = queries.withColumn("code", coded("vector")).withColumn("leads", leads("code")).select("query_id", "query_hash", "vector", "code", F.posexplode("leads").alias("part", "own"))
    may = F.array(*[F.lit(r) for r in reach])
    sent = sent.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit((1 << lead) - 1))))
    sent = sent.where(F.bit_count(F.col("own").bitwiseXOR(F.col("lead"))) <= F.element_at(may, F.col("part") + 1))
    sent = sent.join(blocks, ["part", "lead"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # queries also in chunks, so that a task's queries are bounded as its rows are
    chunks = max(1, -(-queries.count() // BLOCK_ROWS))
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(chunks)))
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    key = ["part", "lead", "block", "chunk"]
    asked = sent.select(*key, "query_id", "query_hash", "vector", "code")
    return asked.groupBy(*key).cogroup(index.select(*key, *given).groupBy(*key)).applyInPandas(_probe(coder, radius, k), FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, query_rows: for each row of queries its k nearest rows of vectors but itself.

    Both tables have id_col and vector_col; bits is a multiple of 64. See the module's text.
    """

    def clean(df: DataFrame, name: str, mark: str, number: str) -> DataFrame:
        good = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
        good = good.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast("array<double>").alias("vector"))
        # a zero's sign makes no difference to an inner product but would to a hash
        good = good.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x)))
        own = F.xxhash64("vector")
        return good.groupBy(name, own.alias(mark)).agg(F.first("vector").alias("vector"), F.count("*").alias(number))

    rows, asked = save(clean(vectors, "vec_id", "hash", "copies"), "vectors"), save(clean(queries, "query_id", "query_hash", "query_rows"), "queries")
    out = [_of_width(rows.where(F.size("vector") == n), asked.where(F.size("vector") == n), k, bits) for n in widths(asked, "vector")]
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_rows long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.join(asked.select("query_id", "query_hash", "query_rows"), ["query_id", "query_hash"]).select("query_id", F.col("rank").cast("int"), "vec_id", "score", "query_rows")


def _of_width(rows: DataFrame, asked: DataFrame, k: int, bits: int) -> DataFrame:
    """query_id, query_hash, vec_id, score, rank of queries and rows whose vectors have one length."""
    n_rows, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64(F.lit(SEED + 1), "vec_id"), "vec_id", "hash").limit(SAMPLE).select("vector").toPandas()
    if not len(sample):
        return asked.limit(0).selectExpr("query_id", "query_hash", "query_id AS vec_id", "0D AS score", "1 AS rank")
    coder = Coder(_matrix(sample["vector"]), bits)
    radius = _calibrate(rows, coder, k)
    found = save(_top(_search(asked, rows, coder, radius, k, n_rows), k), "found")
    want = min(k, n_all - 1)
    full = found.groupBy("query_id", "query_hash").count().where(F.col("count") >= want)
    short = save(asked.join(full, ["query_id", "query_hash"], "left_anti"), "short")
    if want > 0 and not short.isEmpty():
        again = _top(_search(short, rows, coder, bits, k, n_rows), k)
        found = found.join(short.select("query_id", "query_hash"), ["query_id", "query_hash"], "left_anti").unionByName(again)
    return found
