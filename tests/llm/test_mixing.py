from __future__ import annotations

import random

import numpy as np
import pytest

from tesserae.llm.mixing import fit, knapsack, mix, targets

from .helpers import docs, words


def test_targets_reshare():
    assert targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333]
    assert targets([10, 1000, 1000]) == pytest.approx([20, 1996.6666666666667, 998.3333333333334])
    assert targets([0, 0]) == [0.0, 0.0]
    assert targets([]) == []
    assert sum(targets([5, 7, 90, 1, 33])) == pytest.approx(1.5 * 136)


def test_knapsack_is_nearest():
    rng = random.Random(5)
    for _ in range(200):
        lengths = np.array(rng.sample(range(1, 30), rng.randint(1, 5)))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 60)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        picked = knapsack(lengths, counts, budget)
        assert (picked <= counts).all() and (picked >= 0).all()
        reachable = [s for s in sums if s <= budget + lengths.max()]
        assert abs(int((picked * lengths).sum()) - budget) == min(abs(s - budget) for s in reachable)


def test_fit_takes_a_share_of_every_length():
    lengths, counts = np.array([1, 10, 1000]), np.array([1000, 1000, 1000])
    take = fit(lengths, counts, 505_500)
    assert abs(int((take * lengths).sum()) - 505_500) == 0
    assert (take >= counts * 505_500 // int((lengths * counts).sum()) - 1).all()


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "zz"), (1, rows[1][1], rows[1][2]), (None, "x y", "b")]
    found = mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {}
    for i, t, s in rows:
        by[s] = by.get(s, 0) + len(words(t))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    expected = dict(zip(order, targets([by[s] for s in order]), strict=True))
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in found:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(expected[s]) and r["source_size"] == by[s]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in by)
    again = mix(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mix(docs(spark, [])).count() == 0
