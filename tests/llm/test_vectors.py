from __future__ import annotations

import time

import numpy as np
import pytest

from tesserae.llm.ann_mih import nearest, shares
from tesserae.llm.collision_projections import HALF, LINES, _Forest, farthest, least_count, near_vectors, tables

from .helpers import groups

SCHEMA = "vec_id long, embedding array<double>, label int, score double"


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.5) for i, v in rows], SCHEMA)


def _odd(d):
    return [(9001, None), (9002, [0.0] * d), (9003, [float("nan")] * d), (9004, [float("inf")] + [1.0] * (d - 1)), (9005, [None] + [1.0] * (d - 1)), (9006, [1.0, 2.0]), (9007, [])]


def test_shares_keep_the_pigeonhole():
    for radius in range(65):
        own = shares(radius, 4)
        assert sum(s + 1 for s in own) == radius + 1  # one short of letting all substrings miss


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x[100:140] = x[100]  # ties
    rows = [(i, v) for i, v in enumerate(x)] + _odd(32)
    table = _table(spark, rows)
    found = nearest(table, table.where("vec_id % 20 = 0"), k=20).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [i for i in range(0, 1500, 20)]
    hit = 0
    for q, own in by.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        score = np.add.reduce(x * x[q], axis=1)
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        score[q] = -np.inf
        hit += len({v for _, v, _ in own} & set(np.lexsort((np.arange(1500), -score))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(by)


def test_few_candidates(spark):
    table = _table(spark, [(0, [1, 0]), (1, [0.5, 0]), (20, [-1, 0.1]), (20, [-1, 0.1]), (None, [1, 1]), *_odd(2)[:5]])
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["query_rows"]) for r in nearest(table, table.where("vec_id % 20 = 0"), k=20).collect())
    assert found == [(0, 1, 1, 1), (0, 2, 20, 1), (0, 3, 20, 1), (20, 1, 20, 2), (20, 2, 1, 2), (20, 3, 0, 2)]
    assert nearest(_table(spark, []), _table(spark, [])).count() == 0


def test_every_row_and_every_length_takes_part(spark):
    table = _table(spark, [(0, [1, 0]), (0, [2, 0]), (1, [3, 0]), (20, [1, 1, 1]), (2, [1, 1, 2]), (40, [1, 1, 1, 1]), (3, [0, 1])])
    found = nearest(table, table.where("vec_id % 20 = 0"), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(0, 1, 1, 3.0), (0, 1, 1, 6.0), (0, 2, 0, 2.0), (0, 2, 0, 2.0), (20, 1, 2, 4.0)]


def test_many_copies_of_one_row(spark):
    table = _table(spark, [(20, [1, 0])] * 30 + [(5, [2, 0])] * 3 + [(0, [1, 1])])
    found = nearest(table, table.where("vec_id % 20 = 0"), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["query_rows"]) for r in found) == [
        *[(0, i, 5, 1) for i in (1, 2, 3)], (0, 4, 20, 1), (0, 5, 20, 1), *[(20, i, 5, 30) for i in (1, 2, 3)], (20, 4, 0, 30), (20, 5, 20, 30)]


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    near = base[:60] + rng.normal(size=(60, 24)) * rng.choice([0.02, 0.1, 0.3], size=(60, 1))
    hub = base[0] + rng.normal(size=(80, 24)) * 0.1
    x = np.concatenate([base, near, hub, base[5:8], base[5:8] * 2])
    n = len(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(i, j) for i in range(n) for j in range(i) if u[i] @ u[j] >= 0.95]
    expected = groups(range(n), links)
    degree = np.zeros(n, int)
    for i, j in links:
        degree[[i, j]] += 1
    order = rng.permutation(n)
    found = {r["vec_id"]: r for r in near_vectors(_table(spark, [(int(i), x[i]) for i in order] + _odd(24))).collect()}
    assert [found[i]["n_links"] for i in range(n)] == degree.tolist()
    assert {i: found[i]["component_id"] for i in range(n)} == expected
    assert all(found[i]["kept"] and found[i]["n_links"] == 0 for i, _ in _odd(24))
    assert near_vectors(_table(spark, [])).count() == 0 and near_vectors(_table(spark, _odd(3)[:5])).count() == 5


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.001]), (5, [0.0, -1.0]), (5, [0.0, -1.0])]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(_table(spark, rows)).collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (5, 0, 5, True)]


def test_a_dense_group_makes_a_spanning_forest_at_once():
    forest = _Forest(4096)
    a, b = np.triu_indices(4096, 1)
    begun, tree = time.perf_counter(), []
    for i in range(0, len(a), 1 << 16):
        tree += forest.spanning(a[i : i + (1 << 16)], b[i : i + (1 << 16)])
    assert len(tree) == 4095 and time.perf_counter() - begun < 5


def test_counts_and_tables_are_calibrated():
    rng = np.random.default_rng(3)
    gap = rng.normal(size=(20_000, LINES)) * np.sqrt(0.1)
    apart = rng.normal(size=(20_000, LINES)) * np.sqrt(2)
    assert (np.abs(gap) <= HALF).sum(axis=1).min() >= least_count()
    assert ((np.abs(apart) <= HALF).sum(axis=1) >= least_count()).mean() < 0.02  # pairs at random are pruned
    for n in (10_000, 1_000_000):
        count, groups, lines = tables(n)
        x, z = rng.normal(size=(2, 400, count, groups, lines))
        met = (farthest(x) == farthest(0.95 * x + np.sqrt(1 - 0.95**2) * z)).all(axis=2).any(axis=1)
        assert met.all() and (2 * lines) ** groups >= n / 512


def test_pairs_just_above_the_threshold_are_linked(spark):
    rng = np.random.default_rng(6)
    n, d = 3000, 64
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(n, d))
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.95001 * x + np.sqrt(1 - 0.95001**2) * side
    found = {r["vec_id"]: r for r in near_vectors(_table(spark, [*enumerate(x), *enumerate(y, n)])).collect()}
    assert all(found[i]["n_links"] == found[n + i]["n_links"] == 1 and found[n + i]["component_id"] == i for i in range(n))


def test_links_among_many_vectors_and_lengths(spark):
    """20,000 vectors in cells: a third near one direction, planted pairs at the threshold, another length, repeated rows."""
    rng = np.random.default_rng(8)
    n, d = 20_000, 32
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1500] = x[0] + rng.normal(size=(1500, d)) * 0.035  # links inside, and some that just miss
    side = rng.normal(size=(500, d))
    own = x[2000:2500]
    side -= (side * own).sum(axis=1)[:, None] * own
    x[3000:3500] = 0.9501 * own + np.sqrt(1 - 0.9501**2) * side / np.linalg.norm(side, axis=1)[:, None]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    degree, links = np.zeros(n, int), []
    for a in range(0, n, 1000):
        i, j = np.nonzero(u[a : a + 1000] @ u.T >= 0.95)
        i += a
        links += [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if p < q]
        degree += np.bincount(i[i != j], minlength=n)
    other = [(n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, [1.0]), (n + 7, [1.0])]
    found = {r["vec_id"]: r for r in near_vectors(_table(spark, [*enumerate(x), *other])).collect()}
    assert [found[i]["n_links"] for i in range(n)] == degree.tolist()
    assert {i: found[i]["component_id"] for i in range(n)} == groups(range(n), links)
    assert found[n + 5]["n_links"] == found[n + 6]["n_links"] == 1 and found[n + 6]["component_id"] == n + 5 and found[n + 7]["n_links"] == 0
