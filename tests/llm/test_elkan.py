"""Product codes against plain rounds in whole numbers, and the bounds' promises."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from tesserae.llm import elkan_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    others, kept = [r for r in kept if len(r[1]) != n], [r for r in kept if len(r[1]) == n]
    w = n // parts
    cut = lambda v: [tuple(v[p * w : (p + 1) * w]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in kept:
                own.setdefault(nearest(cut(r[1])[p], books[p])[1], []).append(cut(r[1])[p])
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], {}
    for i, v, label in kept:
        found = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted([(str(i), c, e, totals[label], digest) for i, c, e, label in out] + [(str(r[0]), None, None, None, digest) for r in others], key=str)


def rows_of(found):
    return sorted([(str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 0.5) for i, v, label in rows], SCHEMA)


def test_against_plain_rounds(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(700)]
    rows += [(700 + i, [round(rng.uniform(-1, 1) * 4) / 4 for _ in range(8)], 1) for i in range(200)]  # many ties
    rows += [rows[3], rows[3], (None, rows[5][1], None), (950, None, 1), (951, [0.1] * 7 + [None], 1), (952, [float("nan")] * 8, 1), (953, [float("inf")] + [0.0] * 7, 2), (954, [0.5] * 4, 2), (955, [], 2), (956, [30000.0] * 8, 9)]
    rng.shuffle(rows)
    assert rows_of(elkan_codes.compress(frame(spark, rows))) == plain(rows)
    assert rows_of(elkan_codes.compress(frame(spark, rows), parts=2, entries=16, rounds=6)) == plain(rows, 2, 16, 6)


def test_few_rows_and_none(spark):
    rows = [(5, [0.25, -0.25, 0.0, 1.0], 1), (5, [0.25, -0.25, 0.0, 1.0], 1), (9, [0.0, 0.0, 0.0, 0.0], None)]
    assert rows_of(elkan_codes.compress(frame(spark, rows))) == plain(rows)
    assert rows_of(elkan_codes.compress(frame(spark, []))) == []
    assert rows_of(elkan_codes.compress(frame(spark, [(1, None, 1)]))) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    x = rng.integers(-600, 600, (500, 4))
    books = elkan_codes.Books(x[:40][None].copy())
    code, _, upper, lower = elkan_codes.first_bounds(x, books.entries[0])
    looked = 0
    for _ in range(6):
        sums = np.zeros((1, 40, 5), np.int64)
        np.add.at(sums[0], code, np.concatenate([np.ones((500, 1), np.int64), x], axis=1))
        books = elkan_codes._moved(books, sums)
        lower = elkan_codes._unpacked(elkan_codes._packed(lower))
        code, upper, lower, taken = elkan_codes.assign(x, code, upper, lower, books, 0)
        exact = elkan_codes.squared(x, books.entries[0])
        assert (code == exact.argmin(axis=1)).all()
        assert (upper.astype(np.int64) ** 2 >= exact[np.arange(500), code]).all() and (lower.astype(np.int64) ** 2 <= exact).all()
        looked += taken
    assert looked < 6 * 500 * 40 / 2


def test_roots_and_large_numbers():
    squares = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1], np.int64)
    assert elkan_codes.root(squares).tolist() == [math.isqrt(s) for s in squares.tolist()]
    x = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    assert elkan_codes.squared(x, x).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]
