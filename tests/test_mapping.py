"""Mapping by seeds against mapping every tag to every reference."""

from __future__ import annotations

import random

import pytest

from tesserae.operators import mapping, search
from tesserae.operators.kernels import MAP_SCORES, Kernel, tag_profile


@pytest.mark.parametrize("loss", [0, 4, 17, 40])
def test_same_places_as_all_pairs(spark, loss):
    rng = random.Random(loss)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    tags = [(i, letters(rng.choice([4, 9, 14, 22]))) for i in range(25)] + [(30, "ACGTNACG"), (31, None), (32, ""), (33, "acg t-ACGGTT"), (34, "ACGTNACG")]
    refs = []
    for k in range(14):
        text = letters(rng.choice([0, 3, 60, 400]))
        for _ in range(3):  # tags with errors
            tag = list(rng.choice(tags[:25])[1])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(tag))
                tag[at] = rng.choice([rng.choice("ACGT"), "", tag[at] + rng.choice("ACGT")])
            cut = rng.randint(0, len(text))
            text = text[:cut] + "".join(tag) + text[cut:]
        refs.append((k, text))
    refs += [(100, None), (101, ""), (102, "NNNN" + letters(50))]
    references = spark.createDataFrame(refs, "seq_id long, raw string")
    clean = {i: "".join(c for c in (t or "").upper() if c.isalpha()) for i, t in tags}
    bound = {i: int((k := Kernel(tag_profile(t))).best_scores([k.encode(t)])[0]) - loss for i, t in clean.items() if t}
    every = search.map_tags(references, [(str(i), t) for i, t in clean.items() if t]).collect()
    expected = sorted((r["seq_id"], int(r["tag"]), r["begin"], r["end"], r["score"]) for r in every if r["score"] >= bound[int(r["tag"])])
    found = mapping.map_tables(references, spark.createDataFrame(tags, "tag_id long, tag string"), loss)
    assert found.columns == ["seq_id", "tag_id", "begin", "end", "score"]
    assert sorted(tuple(r) for r in found.collect()) == expected and expected


def test_refusals_and_empty_tables(spark):
    refs, tags = spark.createDataFrame([], "seq_id long, raw string"), spark.createDataFrame([], "tag_id long, tag string")
    assert mapping.map_tables(refs, tags, 4).collect() == []
    free = {k: dict(v) for k, v in MAP_SCORES.items()}
    free["Scores"]["MisMatch"] = 3
    with pytest.raises(ValueError, match="seed"):
        mapping.map_tables(refs, tags, 4, free)
    with pytest.raises(ValueError, match="rename"):
        mapping.map_tables(refs, tags, 4, key="tag_id")
    assert mapping.least_loss() == 4
