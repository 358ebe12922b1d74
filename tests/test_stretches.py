"""Stretches against whole sequences, and ends and paths against walks through all cells."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tesserae.operators import search
from tesserae.operators.kernels import CIRCULAR, EXTENDED, GLOCAL, STANDARD, Kernel, tag_profile
from tesserae.operators.stretches import NO, Stretches
from tesserae.sources.profiles import NLOW, X, simple_profile

from .test_kernels import random_profile


def some_profile(rng, model):
    length = rng.randint(1, 6)
    if rng.random() < 0.4:
        return simple_profile("".join(rng.choice("ACGT") for _ in range(length)), "ACGT", circular=model == CIRCULAR)
    return random_profile(rng, length, model == CIRCULAR)


def by_cells(kernel, letters, bound, limit, first_row):
    """Hits from all cells, each found by looking at all rows anew."""
    scores, moves, wraps = kernel.matrix(kernel.encode(letters))
    n, out = len(scores) - 1, []
    used = np.zeros(n + 1, bool)
    ends = scores[1:, 1:, X].astype(np.int64)
    while n:
        best = np.where(used[1:], NO, ends.max(axis=1))
        if best.max() <= NLOW or best.max() < bound:
            break
        row = 1 + (int(np.argmax(best)) if first_row else n - 1 - int(np.argmax(best[::-1])))
        col = kernel.length - int(np.argmax(ends[row - 1, ::-1]))
        begin, entry, cycles, _, states, aligned, _ = kernel.trace(moves, wraps, row, col, letters)
        overlap = used[begin : row + 1].any()
        used[begin : row + 1] = True
        if not overlap:
            out.append((int(best.max()), cycles, begin, row, entry, col, states, aligned))
            if limit and len(out) >= limit:
                break
    return out


def tuples(found):
    return [(h.score, h.cycles, h.row_begin, h.row_end, h.col_begin, h.col_end, h.states, h.aligned) for h in found]


@pytest.mark.parametrize("model", [STANDARD, CIRCULAR, GLOCAL, EXTENDED])
def test_scores_and_hits(model, monkeypatch):
    rng = random.Random(f"{model}2")
    plain = Stretches.__init__
    for _ in range(12):
        kernel = Kernel(some_profile(rng, model), model)
        texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        best = kernel.best_scores([kernel.encode(t) for t in texts])
        for size in (3, 11, None):
            monkeypatch.setattr(Stretches, "__init__", lambda self, k, s, stretch=None, *a, size=size: plain(self, k, s, size, *a))
            assert (kernel.best_scores([kernel.encode(t) for t in texts]) == best).all()
            for bound, limit, first in ((-50, None, False), (5, None, False), (-(1 << 30), 1, True)):
                try:
                    expected = [by_cells(kernel, t, bound, limit, first) for t in texts]
                except ValueError:  # a ring of free steps
                    with pytest.raises(ValueError):
                        kernel.many_hits(texts, bound, limit, None, first)
                    continue
                assert [tuples(h) for h in kernel.many_hits(texts, bound, limit, None, first)] == expected
                places = kernel.many_hits(texts, bound, limit, None, first, paths=False)
                assert [[x[:6] for x in tuples(h)] for h in places] == [[x[:6] for x in e] for e in expected]
        monkeypatch.setattr(Stretches, "__init__", plain)


def test_an_alignment_carried_far_needs_matrices(monkeypatch):
    # insertions are free, so half a tag waits for the other half over many stretches
    kernel = Kernel(tag_profile("ACGTACGTACGTTTGGCCAATTGG"))
    rng = random.Random(3)
    letters = "ACGTACGTACGT" + "".join(rng.choice("ACGT") for _ in range(9000)) + "TTGGCCAATTGG"
    seq = kernel.encode(letters)
    calls = []
    plain = Stretches._by_matrices
    monkeypatch.setattr(Stretches, "_by_matrices", lambda self, *a: calls.append(1) or plain(self, *a))
    whole = Stretches(kernel, [seq], len(seq)).best()
    assert not calls and Stretches(kernel, [seq], 500).best() == whole and calls
    hit = kernel.many_hits([letters], -(1 << 30), 1, first=True, paths=False)[0][0]
    assert hit.score == whole[0] and (hit.states, hit.aligned) == ("", "")


def test_gain_bounds_what_follows():
    rng = random.Random(8)
    for _ in range(30):
        kernel = Kernel(random_profile(rng, rng.randint(1, 5)))
        gain = kernel.gain()
        silent = kernel.silent()
        for at, gains in enumerate(gain):
            for col in range(kernel.length + 1):
                start = np.full((2, 1, kernel.length + 1), NO)
                start[at, 0, col] = 0
                m, i = start
                for step in range(8):
                    m, i, end = silent.advance(m, i, np.array([rng.randint(0, 4)]), np.array([0]) if step == 7 else np.zeros(0, np.int64))
                    assert end.max() <= max(gains[col], NLOW)


def test_long_scores(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 40, 900, 5000])))) for k in range(12)] + [(50, None), (51, "ACGT" * 2000)]
    df = spark.createDataFrame(rows, "seq_id long, raw string")
    for profile, model in ((simple_profile("ACGGT", "ACGT"), None), (simple_profile("CAG", "ACGT", circular=True), None), (random_profile(rng, 4), None), (tag_profile("ACGTACGTAC"), None), (random_profile(rng, 3), EXTENDED)):
        expected = {r["seq_id"]: r["score"] for r in search.best_scores(df, [profile], model=model).collect()}
        found = search.long_scores(df, profile, model, size=64)
        assert {r["seq_id"]: r["score"] for r in found.collect()} == expected


def test_places_without_paths(spark):
    df = spark.createDataFrame([(1, "TTACGTTTACGTA"), (2, None), (3, "")], "seq_id long, raw string")
    profile = simple_profile("ACGT", "ACGT", cutoff=6)
    full = search.search(df, [profile], both_strands=True).drop("states", "aligned")
    places = search.search(df, [profile], both_strands=True, paths=False)
    assert {r["states"] for r in places.collect()} == {""}
    assert sorted(places.drop("states", "aligned").collect()) == sorted(full.collect())


@pytest.mark.parametrize("name", ["score", "rank", "states"])
def test_keys_do_not_meet_result_columns(spark, name):
    df = spark.createDataFrame([(1, "ACGT")], f"{name} long, raw string")
    with pytest.raises(ValueError, match="rename"):
        search.search(df, [simple_profile("ACGT", "ACGT")], key=name)


def test_many_hits_of_a_long_sequence():
    rng = random.Random(2)
    kernel = Kernel(simple_profile("ACG", "ACGT"))
    letters = "".join(rng.choice("ACGT") for _ in range(20_000))
    found = kernel.hits(letters, 6)
    assert len(found) > 300
    assert tuples(found) == by_cells(kernel, letters, 6, None, False)


def test_batches_are_cut_by_letters():
    """Ten thousand long texts of one batch are never scored at once."""
    import pyarrow as pa

    from tesserae.operators.search import portions

    texts = ["A" * n for n in (3, 0, 5, 30, 1, 1, 8)] + [None, "CC"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["k", "t"])
    parts = [p.column(1).to_pylist() for p in portions(batch, letters=10)]
    assert [x for p in parts for x in p] == texts
    assert [len(p) for p in parts] == [3, 1, 4, 1]
    assert [len(p) for p in portions(batch.slice(3), letters=1000)] == [6]
