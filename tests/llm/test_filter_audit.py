"""The audit against filters applied one after the other, and the polynomial against counting."""

from __future__ import annotations

import random
import re
from itertools import permutations

from tesserae.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, part string, words string"


def failing(text, doc_id, first):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if doc_id is not None and first.get(text) is not None and first[text] < doc_id else set())


def plain(rows, labels):
    first, out = {}, set()
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    for part in {lang or "" for _, _, lang in rows}:
        docs = [(i, failing(text or "", i, first)) for i, text, lang in rows if (lang or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                removed_by[f] += len(gone)
                left = [d for d in left if f not in d[1]]
                fails = sum(f in d[1] for d in docs)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f))
        out |= {(*r[:-1], removed_by[r[-1]]) for r in found}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "p", "w") for r in rows], SCHEMA)


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_filters_in_turn(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["UPPER", "Cased", "a#b", "50%"]
    rows = []
    for i in range(300):
        n = rng.choice([0, 3, 99, 100, 101, 140])
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(vocabulary[: rng.choice([60, 300, 304])], k=n)), rng.choice(["en", "de", None, ""])))
    rows += [(1000 + i, rows[5][1], "en") for i in range(80)] + [rows[7], rows[7], (None, rows[5][1], "de"), (None, rows[5][1], "de"), (2000, None, "fr"), (2001, "", None), (2002, "É" * 50 + "A" * 5, "fr"), (2003, "É" * 45 + "A" * 6, "fr"), (2004, " lead and trail ", "fr"), (2005, "word " * 40_000, "fr")]
    rng.shuffle(rows)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 1100, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    found = filter_audit.audit(frame(spark, rows), labelled(spark, labels))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) == 600 * len({lang or "" for _, _, lang in rows})
    assert set(got) == plain(rows, labels)


def test_empty_tables(spark):
    assert filter_audit.audit(frame(spark, []), labelled(spark, [])).collect() == []
    one = filter_audit.audit(frame(spark, [(1, "x", "en")]), labelled(spark, [])).collect()
    assert len(one) == 600 and {r["shapley"] for r in one} == {0, 120}


def test_own_filters(spark):
    filters = {"S": lambda text, words: text.startswith("s"), "L": lambda text, words: text.endswith("l")}
    got = filter_audit.audit(frame(spark, [(1, "s l", "en"), (2, "s", "en"), (3, "s", "en")]), labelled(spark, []), filters).collect()
    assert len(got) == 6 * 3
    assert {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got} == {"S": 3 + 6 + 3, "L": 3, "E": 3}


def test_polynomial():
    rng = random.Random(1)
    counts = {m: rng.randrange(5) for m in range(32)}
    p = filter_audit.Removal(counts, 5)
    for corner in range(32):
        assert p.at(corner) == sum(c for m, c in counts.items() if m & corner)
    for i in range(5):
        by_order = sum(p.at(sum(1 << j for j in order[: order.index(i) + 1])) - p.at(sum(1 << j for j in order[: order.index(i)])) for order in permutations(range(5)))
        assert p.shapley(i) == by_order
