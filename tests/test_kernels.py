"""Vectorised kernels against scalar ones written from the recurrences."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tesserae.operators.kernels import CIRCULAR, EXTENDED, GLOCAL, STANDARD, Kernel, heuristic_score, tag_profile
from tesserae.sources.profiles import DEL, NLOW, D, I, M, Profile, X, simple_profile

NO = -(1 << 40)


def random_profile(rng, length, circular=False):
    score = lambda lo, hi: rng.randint(lo, hi)
    match = np.array([[score(-4, 6) for _ in range(29)] for _ in range(length)])
    insertion = np.array([[score(-5, 1) for _ in range(29)] for _ in range(length + 1)])
    boundary = np.array([[NLOW if rng.random() < 0.2 else score(-6, 2) for _ in range(11)] for _ in range(length + 1)])
    transition = np.array([[NLOW if rng.random() < 0.1 else score(-6, 1) for _ in range(16)] for _ in range(length + 1)])
    n1 = rng.randint(1, length)
    return Profile(alphabet="ACGT", length=length, circular=circular, n1=n1, n2=rng.randint(n1, length), cutoff=[{"level": 0, "score": 0, "modes": []}], consensus="A" * length, match=match, insertion=insertion, boundary=boundary, transition=transition)


def scalar(profile, seq, model):
    """Cells by plain loops: [row][column][state]."""
    t = profile.tables()
    T = lambda j, a, b: int(t["transition"][j][4 * a + b])
    L, n = profile.length, len(seq)
    C = [[[NLOW] * 4 for _ in range(L + 1)] for _ in range(n + 1)]
    F, Z = t["first"], t["last"]
    delete = lambda j: int(profile.match[j - 1][DEL])

    def wrap(row):
        for s in (M, I, D):
            row[0][s] = max(row[0][s], row[L][s])
        for j in range(1, L + 1):
            k = row[j - 1][D] + delete(j)
            for s in (M, I, D):
                row[j][s] = max(row[j][s], k + T(j, D, s))

    if model == GLOCAL:
        C[0][0][M] = int(F[0][M])
    else:
        for j in range(L + 1):
            for s in (M, I, D):
                C[0][j][s] = int(F[j][s]) if j == 0 else max(int(F[j][s]), C[0][j - 1][D] + delete(j) + T(j, D, s))
        if model == CIRCULAR:
            wrap(C[0])
    for i in range(1, n + 1):
        r = seq[i - 1]
        end = i == n
        before0 = None
        for j in range(L + 1):
            ki_row = C[i - 1][j - 1][I] if model == EXTENDED and j else C[i - 1][j][I]
            KI = ki_row + int(profile.insertion[j][r])
            if j == 0 and model in (GLOCAL, EXTENDED):
                KI = NLOW
            top = C[i - 1][j - 1][M] if j else NO
            if model == CIRCULAR and j == 1:
                top = max(before0, top)
            KM = top + int(profile.match[j - 1][r]) if j else NO
            KD = C[i][j - 1][D] + delete(j) if j else NO
            for s in (D, M, I):
                enter = NO if model == GLOCAL and j else T(j, X, s)
                C[i][j][s] = max(KM + T(j, M, s), KI + T(j, I, s), KD + T(j, D, s), enter)
            out = (lambda s: int(Z[j][s])) if end else (lambda s: T(j, s, X))
            C[i][j][X] = max(KM + out(M), KI + out(I), KD + out(D), NLOW)
            if j == 0:
                before0 = C[i][0][M]
        if model == CIRCULAR:
            wrap(C[i])
    return C


@pytest.mark.parametrize("model", [STANDARD, CIRCULAR, GLOCAL, EXTENDED])
def test_matrix_and_scores(model):
    rng = random.Random(model)
    for _ in range(60):
        profile = random_profile(rng, rng.randint(1, 6), model == CIRCULAR)
        kernel = Kernel(profile, model)
        seqs = [np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 12))], np.int64) for _ in range(4)]
        best = kernel.best_scores(seqs)
        for k, seq in enumerate(seqs):
            cells = scalar(profile, seq.tolist(), model)
            if len(seq):
                got, moves, _ = kernel.matrix(seq)
                for s in (M, I, D, X):
                    expected = np.array([[max(c[s], -(1 << 30)) for c in row] for row in cells])
                    rows = slice(1, None) if s == X else slice(None)
                    assert (got[rows, :, s] == expected[rows]).all(), (model, s)
                assert best[k] == max(c[X] for row in cells[1:] for c in row[1:])
            else:
                assert best[k] == NLOW


def test_traceback_explains_its_score():
    rng = random.Random(9)
    for _ in range(100):
        profile = random_profile(rng, rng.randint(1, 5))
        kernel = Kernel(profile)
        text = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 14)))
        t = profile.tables()
        for h in kernel.hits(text, -50):
            path = h.states[1:-1]
            assert len(h.aligned) == len(path) and path.count("M") + path.count("I") == h.row_end - h.row_begin
            assert h.aligned.replace("-", "").upper() == text[h.row_begin : h.row_end]
            row, col, state = h.row_begin, h.col_begin, X
            total = 0
            for c in path:
                s = {"M": M, "I": I, "-": D}[c]
                total += int(t["first"][col][s] if state == X and row == 0 else t["transition"][col][4 * state + s])
                r = kernel.encode(text)[row] if s != D else 0
                row, col = row + (s != D), col + (s != I)
                total += int(profile.match[col - 1][r]) if s == M else int(profile.insertion[col][r]) if s == I else int(profile.match[col - 1][DEL])
                state = s
            total += int(t["last"][col][state] if row == len(text) else t["transition"][col][4 * state + X])
            assert (row, col, total) == (h.row_end, h.col_end, h.score)


def test_hits_do_not_overlap_and_fall():
    rng = random.Random(2)
    kernel = Kernel(simple_profile("ACGT", "ACGT"))
    for _ in range(50):
        found = kernel.hits("".join(rng.choice("ACGT") for _ in range(60)), 5)
        assert [h.score for h in found] == sorted((h.score for h in found), reverse=True)
        rows = [r for h in found for r in range(h.row_begin, h.row_end + 1)]
        assert len(rows) == len(set(rows))


def test_ties_take_the_last_row():
    first = Kernel(simple_profile("ACG", "ACGT")).hits("ACGTTTACGTTT", 9)
    assert [h.seq_begin for h in first] == [6, 0]


def test_cycles():
    kernel = Kernel(simple_profile("CAG", "ACGT", match=5, mismatch=-5, gap=-20, circular=True))
    counts = [kernel.hits("TT" + "CAG" * n + "TT", 10, 1)[0].cycles for n in range(1, 7)]
    assert counts == list(range(1, 7))


def test_tag_mapping():
    tag = Kernel(tag_profile("ACGTN"))
    hit = tag.hits("TTTACGTGTTT", -1000, 1)[0]
    assert (hit.seq_begin, hit.seq_end, hit.score) == (3, 7, 5 * 3 + 5)
    assert tag.hits("", -1000, 1) == []


def test_heuristic_is_the_sum_of_best_runs():
    rng = random.Random(4)
    for _ in range(50):
        table = np.array([[rng.randint(-4, 5) for _ in range(4)] for _ in range(rng.randint(1, 5))])
        seq = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        v = [[int(table[j][seq[0]]) for j in range(len(table))]]
        for c in seq[1:]:
            v.append([max(0, (v[-1][j - 1] if j else 0) + int(table[j][c])) for j in range(len(table))])
        assert heuristic_score(table, np.array(seq)) == sum(max(row[j] for row in v) for j in range(len(table)))
