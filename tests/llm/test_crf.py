from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from tesserae.llm.crf_quality import keep_good, line_features, marginals, quality

from .helpers import docs


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    loff = np.array([0, 1, 5, 8])
    unary, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, log_z = marginals(unary, loff, trans)
    total, moves = 0.0, np.zeros((2, 2))
    for a, b in zip(loff[:-1], loff[1:], strict=True):
        weights = {}
        for states in itertools.product((0, 1), repeat=b - a):
            score = sum(unary[a + i] for i, s in enumerate(states) if s) + sum(trans[x, y] for x, y in itertools.pairwise(states))
            weights[states] = np.exp(score)
        z = sum(weights.values())
        total += np.log(z)
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for s, w in weights.items() if s[i]) / z)
        for s, w in weights.items():
            for x, y in itertools.pairwise(s):
                moves[x, y] += w / z
    assert log_z == pytest.approx(total) and pair == pytest.approx(moves)


def test_lines_do_not_depend_on_neighbours_in_a_chunk():
    texts = [b"Ab c.\n\nAb c.", b"", b"x", b"\n", b"12 | 13!!\nend"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    whole, size, loff = line_features(data, off)
    assert np.diff(loff).tolist() == [3, 1, 1, 2, 2] and size.tolist() == [5, 0, 5, 0, 1, 0, 0, 9, 3]
    for i, t in enumerate(texts):
        own, _, _ = line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert own == pytest.approx(whole[loff[i] : loff[i + 1]])


def _corpus(n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = [" ".join(("X$$ " if bad else "") + rng.choice(["the", "of", "house", "tree"]) for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _corpus(300)
    truth = {i: q for i, q, _ in labels}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality(docs(spark, rows), table).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    good = {r["doc_id"] for r in keep_good(docs(spark, rows), table).collect()}
    assert good == {r["doc_id"] for r in found if r["predicted"]}
    # labels of the held-out rows don't matter
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in quality(docs(spark, rows), flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in found}


def test_odd_rows(spark):
    rows, labels = _corpus(60)
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    odd = [(None, "a b c."), (1001, None), (1002, ""), (1003, "\n\n"), (1004, "word " * 50_000), (1004, "word")]
    found = quality(docs(spark, rows + odd), table).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality(docs(spark, odd), none).collect()} == {(0.5, 1)}
    assert quality(docs(spark, []), table).count() == 0
