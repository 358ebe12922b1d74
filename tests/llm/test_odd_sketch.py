from __future__ import annotations

import random

from tesserae.llm.components import components
from tesserae.llm.odd_sketch import near_duplicates

from .helpers import docs, groups, shingles


def _expected(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    return groups(ids, linked)


def test_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else "  \n".join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "é one two three four five " * 300)]
    found = {r["doc_id"]: r for r in near_duplicates(docs(spark, rows)).collect()}
    expected = _expected(rows)
    assert {i: r["component_id"] for i, r in found.items()} == expected
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_chain_of_links_whose_smallest_is_no_hub(spark):
    # neighbours in the chain are near, its ends are not; all share much
    words = [f"v{i}" for i in range(300)]
    rows = [(50 - k, " ".join(words[8 * k : 8 * k + 120])) for k in range(20)]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows)).collect()}
    assert found == _expected(rows)
    assert len(set(found.values())) == 1


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (None, None), (5, text), (5, text), (4, text), (7, "x y z"), (7, "p q r s t u"), (6, "p q r s t u")]
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(None, None, True)] * 2 + [(5, 4, False)] * 2 + [(4, 4, True), (7, 6, False), (7, 6, False), (6, 6, True)], key=str)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert found == groups(nodes, [e for e in edges if e[0] != e[1]])
