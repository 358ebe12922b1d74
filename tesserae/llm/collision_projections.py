"""Embedding near-duplicates by counting collisions in one-dimensional projections.

Vectors are scaled to length 1 and equal vectors are made one class. In each of several tables a class goes to one cell:
of a group of random lines, the one on which its projection lies farthest out, and the side; with many classes, several
such groups make the cell. Inside a cell the rows are sorted on LINES further projections. A query row's window on a
projection holds the rows whose projections lie within HALF of its own; windows are centred on the query. The rows that
lie in at least `least_count` of a query's windows are its candidates; block products drop those clearly below the
threshold and cosines in double precision verify the others.

Both steps are calibrated for a pair at the threshold, whose projections on a line are two normal variables with the
threshold as their correlation: `tables` draws such pairs and takes so many tables that they meet in one but for a chance
of MISS / 2, and the binomial law gives the largest count that all but MISS / 2 of them reach. Pairs above the threshold
are closer, so at most about MISS of the links is expected to be lost against the exact SQL.

Cells hold CELL rows in the mean whatever the number of rows, so the work grows with the rows. A cell of more than
BLOCK_ROWS rows is cut into blocks that meet in pairs, each pair of blocks in one task; where most vectors point in one
narrow direction, that is most of the work and grows with its square. A pair counts in the first table where it meets. A
task returns link counts a row and only a spanning forest of its links, so n near copies cost n rows; classes count their
members.

Rows: one per input row. Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; null ids neither (component null, kept). Different vectors of one id are vectors of their
own, which may link with each other; rows that repeat id and vector are one vector, each with its result. Extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import save
from .textvec import mix
from .vectors import usable

THRESHOLD = 0.95
LINES, HALF, MISS = 48, 0.3, 1e-6
CELL, BLOCK_ROWS, GROUP = 256, 8192, 64  # rows of a cell in the mean and of a block at most; most lines in a group
STRIP_PAIRS, MARGIN = 1 << 17, 1e-6
DRAWS = 1 << 16
SEED, SALT = 5, 16

LINKS = "a long, b long, links long, tree boolean"  # tree: a link of the forest; else the links of a found here


def least_count(threshold: float = THRESHOLD, lines: int = LINES, half: float = HALF, miss: float = MISS / 2) -> int:
    """The largest count that a pair at the threshold reaches but for a probability of `miss`."""
    p = math.erf(half / math.sqrt(2 - 2 * threshold) / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def farthest(projections: np.ndarray) -> np.ndarray:
    """For each row the line with the largest absolute projection and its side, as one number."""
    line = np.abs(projections).argmax(axis=-1)
    side = np.take_along_axis(projections, line[..., None], axis=-1)[..., 0] < 0
    return line * 2 + side


def tables(n: int, threshold: float = THRESHOLD, miss: float = MISS / 2) -> tuple[int, int, int]:
    """(tables, groups of lines in each, lines in a group) for n classes."""
    cells = n / CELL
    if cells <= 2:
        return 1, 0, 1
    groups = math.ceil(math.log(cells) / math.log(2 * GROUP))
    lines = max(2, math.ceil(cells ** (1 / groups) / 2))
    rng = np.random.default_rng(SEED)
    hits = 0
    for _ in range(DRAWS // 4096):
        x, z = rng.normal(size=(2, 4096, lines))
        hits += int((farthest(x) == farthest(threshold * x + math.sqrt(1 - threshold**2) * z)).sum())
    p = hits / DRAWS
    p = (p - 4 * math.sqrt(p * (1 - p) / DRAWS)) ** groups  # four standard errors on the safe side
    return math.ceil(math.log(miss) / math.log1p(-p)), groups, lines


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed in one fixed order."""
    dot = np.add.reduce(x * y, axis=1)
    return dot / np.sqrt(np.add.reduce(x * x, axis=1) * np.add.reduce(y * y, axis=1))


class _Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while (up[up] != up).any():
            up = up[up]
        self.up = up.tolist()
        return up

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links among (a, b) that join two trees; most of a dense group's fall out at once."""
        root = self.roots()
        new = root[a] != root[b]
        return [(i, j) for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True) if self.join(i, j)]


def collide(lines: np.ndarray, x: np.ndarray, y: np.ndarray, half: float, count: int, same: bool):
    """(rows of x, rows of y) of the pairs where the window of the first holds the second at least count times, strip by strip.

    same: x and y are the same rows, and the second comes after the first.
    """
    px, py = (x @ lines).T, (y @ lines).T
    n, m, step = len(x), len(y), max(1, STRIP_PAIRS // len(y))
    kind = np.uint16 if m < 1 << 16 else np.uint32
    rank = np.empty((len(py), m), kind)  # of each row of y on each line
    low, size = np.empty((len(px), n), kind), np.empty((len(px), n), kind)  # the first rank of each window and how many it holds
    for j, (line, own) in enumerate(zip(py, px, strict=True)):
        order, mine = np.argsort(line, kind="stable"), np.argsort(own)
        rank[j, order] = np.arange(m)
        line, own = line[order], own[mine]
        first = np.searchsorted(line, own - half, "left")
        low[j, mine], size[j, mine] = first, np.searchsorted(line, own + half, "right") - first
    for first in range(0, n, step):
        seen = np.zeros((min(step, n - first), m), np.uint8)
        for at, lo, held in zip(rank, low[:, first : first + step], size[:, first : first + step], strict=True):
            seen += at[None, :] - lo[:, None] < held[:, None]  # ranks below the window wrap round
        a, b = np.nonzero(seen >= count)
        a = a + first
        if same:
            a, b = a[b > a], b[b > a]
        yield a, b


def _pairs(threshold: float):
    count = least_count(threshold)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[1]), int(key[2])
        left = pdf[pdf["block"] == low]
        right = left if low == high else pdf[pdf["block"] == high]
        if not len(left) or not len(right) or low == high and len(left) < 2:
            return pd.DataFrame({"a": [], "b": [], "links": [], "tree": []})
        names = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()]) if low != high else left["node"].to_numpy()
        table = int(left["number"].iloc[0])
        x, y = (np.stack(f["vector"].to_numpy()).astype(np.float64) for f in (left, right))
        ux, uy = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
        cx, cy = (np.stack(f["before"].to_numpy()) for f in (left, right)) if table else (None, None)
        nx, ny = left["copies"].to_numpy(), right["copies"].to_numpy()
        lines = np.random.default_rng(SEED).normal(size=(x.shape[1], LINES))
        shift = 0 if low == high else len(left)
        links = np.zeros(len(names), np.int64)
        forest, tree = _Forest(len(names)), []
        for a, b in collide(lines, ux, uy, HALF, count, low == high):
            for i in range(0, len(a), 1 << 16):
                p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                near = np.einsum("ij,ij->i", ux[p], uy[q]) >= threshold - MARGIN
                p, q = p[near], q[near]
                if table:
                    new = ~(cx[p] == cy[q]).any(axis=1)  # not met before
                    p, q = p[new], q[new]
                real = cosine(x[p], y[q]) >= threshold
                p, q = p[real], q[real]
                np.add.at(links, p, ny[q])
                np.add.at(links, q + shift, nx[p])
                tree += forest.spanning(p, q + shift) if len(p) else []
        some = np.flatnonzero(links)
        rows = [pd.DataFrame({"a": names[some], "b": names[some], "links": links[some], "tree": False})]
        if tree:
            t = np.array(tree)
            rows.append(pd.DataFrame({"a": names[t[:, 0]], "b": names[t[:, 1]], "links": 0, "tree": True}))
        return pd.concat(rows)

    return run


def _cells(n_tables: int, groups: int, lines: int):
    """The cells of each vector, a number for each table."""

    def keys(vectors: np.ndarray) -> np.ndarray:
        drawn = np.random.default_rng(SEED + 1).normal(size=(vectors.shape[1], n_tables * groups * lines))
        out = np.empty((len(vectors), n_tables), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(vectors), 1024):
                at = farthest((vectors[i : i + 1024] @ drawn).reshape(-1, n_tables, groups, lines)).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, n_tables + 1, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(vectors.shape[1]), at.shape[:2])
                for g in range(groups):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + at[:, :, g])
                out[i : i + 1024] = mix(key)
        return out.view(np.int64)

    @F.pandas_udf("array<long>")
    def cells(column: pd.Series) -> pd.Series:
        out, sizes = [None] * len(column), column.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for i, own in zip(at.tolist(), keys(np.stack(column.to_numpy()[at]).astype(np.float64)), strict=True):
                out[i] = own
        return pd.Series(out, dtype=object)

    return cells


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors; see the module's text."""
    key = F.col("vec_id") == F.coalesce("component_id", "vec_id")
    good = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    one = good.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    # nodes are numbered: an id may have several vectors, and so several classes
    classes = save(one.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    n_tables, groups, lines = tables(classes.count(), threshold)
    celled = classes.withColumn("cells", _cells(n_tables, groups, lines)("vector") if groups else F.array(F.size("vector").cast("long")))
    placed = save(celled.select("node", "copies", "vector", "cells"), "cells")
    # a row takes along 32 bits of each cell that it had in earlier tables
    dealt = placed.select("*", F.posexplode("cells").alias("number", "cell"))
    dealt = dealt.withColumn("before", F.transform(F.slice("cells", F.lit(1), F.col("number")), lambda c: F.shiftright(c, 32).cast("int"))).drop("cells")
    # a row for each cell of more than BLOCK_ROWS rows
    large = save(placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > BLOCK_ROWS).select("cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "large")
    blocks = F.coalesce("blocks", F.lit(1))
    blocked = dealt.join(large, "cell", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = blocked.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "number", "node", "copies", "vector", "before")
    found = save(met.groupBy("cell", "low", "high").applyInPandas(_pairs(threshold), LINKS), "links")
    parts = components(found.where("tree"), "a", "b").join(classes.select("node", "rep"), "node")
    # a component's smallest id, back to its members in SALT parts
    least = parts.groupBy("component").agg(F.min("rep").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    labelled = parts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(least, ["component", "salt"]).select("node", "least")
    counts = found.where("not tree").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = classes.join(counts, "node", "left").join(labelled, "node", "left")
    joined = joined.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "rep").alias("component_id"))
    mine = one.join(joined, "vector").select("vec_id", "links", "component_id")
    alone = vectors.where(~(usable(F.col(vector_col)) & F.col(id_col).isNotNull())).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component_id"))
    out = mine.unionByName(alone)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(key, F.lit(True)).alias("kept"))
