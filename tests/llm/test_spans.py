from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm.sentence_spans import MAX_WORDS, SENTENCES, WORDS, cut, dedup_passages, dedup_spans, runs

from .helpers import docs


def _sentences(text):
    """[(start, end, words)] by plain scanning."""
    out, at, n = [], 0, len(text)
    words, spans, i = [], [], 0
    while i < n:
        while i < n and text[i] in " \t\n\r\x0b\x0c":
            i += 1
        j = i
        while j < n and text[j] not in " \t\n\r\x0b\x0c":
            j += 1
        if j > i:
            spans.append((i, j))
        i = j
    current = []
    for k, (a, b) in enumerate(spans):
        current.append((a, b))
        gap = text[b : spans[k + 1][0]] if k + 1 < len(spans) else ""
        if text[b - 1] in ".!?" or "\n" in gap or len(current) == MAX_WORDS or k + 1 == len(spans):
            out.append((current[0][0], current[-1][1], tuple(text[x:y].lower() for x, y in current)))
            current = []
    del at, words
    return out


def _runs(sentences):
    found = set()
    for i in range(len(sentences)):
        for step in (1, -1):
            j, n = i, 0
            while 0 <= j < len(sentences):
                n += len(sentences[j][2])
                if abs(j - i) + 1 >= SENTENCES and n >= WORDS:
                    found.add((min(i, j), max(i, j)))
                    break
                j += step
    return found


def _expected(rows):
    """Sentences that stay of each document, by brute force."""
    first, places = {}, {}
    parts = {i: _sentences(t) for i, t in rows if i is not None and t}
    for i in sorted(parts):
        for a, b in sorted(_runs(parts[i])):
            key = tuple(w for s in parts[i][a : b + 1] for w in s[2])
            places.setdefault(i, []).append((key, a, b))
            first[key] = min(first.get(key, (i, a)), (i, a))
    gone = {i: {k for key, a, b in places.get(i, []) if first[key] != (i, a) for k in range(a, b + 1)} for i in parts}
    return {i: [s[2] for k, s in enumerate(parts[i]) if k not in gone[i]] for i in parts}, {i: len(g) for i, g in gone.items()}


def test_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 15, 30]))) + rng.choice([".", "!", "?", ""])
    shared = [[sentence() for _ in range(rng.randint(2, 8))] for _ in range(6)]
    rows = []
    for i in range(50):
        parts = [sentence() for _ in range(rng.randint(0, 6))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts[at:at] = s
        rows.append((i * 3 % 50, rng.choice([" ", "\n", " \n "]).join(parts)))
    kept, gone = _expected(rows)
    found = {r["doc_id"]: r for r in dedup_spans(docs(spark, rows)).collect()}
    for i, t in rows:
        if i in kept:
            assert found[i]["n_removed"] == gone[i], i
            assert " ".join(found[i]["text"].lower().split()) == " ".join(w for s in kept[i] for w in s), i
            if not gone[i]:
                assert found[i]["text"] == t


def test_passage_of_more_than_fifty_words_goes(spark):
    rng = random.Random(1)
    passage = ". ".join(" ".join(f"p{rng.randrange(10**6)}" for _ in range(n)) for n in (7, 12, 3, 18, 14)) + "."
    own = lambda k: " ".join(f"d{k}x{j}" for j in range(30)) + "."
    rows = [(k, f"{own(k)}\n{passage}\n{own(k + 100)}") for k in range(5)]
    found = {r["doc_id"]: r["text"] for r in dedup_spans(docs(spark, rows)).collect()}
    assert found[0] == rows[0][1]
    assert all(found[k] == f"{own(k)}\n{own(k + 100)}" for k in range(1, 5))


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    text = " ".join(f"a{i}" for i in range(25)) + ".\n" + " ".join(f"b{i}" for i in range(25)) + "."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text), (5, long), (6, long)]
    found = [(r["doc_id"], r["text"], r["n_removed"]) for r in dedup_spans(docs(spark, rows)).collect()]
    assert found.count((1, text, 0)) == 2 and (None, text, 0) in found and (2, None, 0) in found and (3, "", 0) in found
    assert (4, "", 4) in found and (5, long, 0) in found and (6, "", 3000) in found
    extra = docs(spark, rows).withColumn("n_removed", F.col("rank"))
    assert dedup_spans(extra).columns.count("n_removed") == 1
    assert dedup_spans(docs(spark, [])).count() == 0


def test_cut_and_runs():
    assert cut(b"A b. C d. E f.", np.array([[1, 1]])) == (b"A b. E f.", 3, 1)
    assert cut(b"A b.\nC d.\nE f.", np.array([[0, 0]])) == (b"C d.\nE f.", 3, 1)
    assert cut(b"", None) == (b"", 0, 0)
    assert len(runs(np.array([0]), 30)[0]) == 0


def test_a_repeated_id_with_a_shorter_text(spark):
    part = lambda k: " ".join(f"{k}{j}" for j in range(15)) + "."
    shared = " ".join(part(k) for k in "abcd")
    rows = [(1, shared), (2, f"{part('x')} {part('y')}\n{shared}"), (2, f"{part('p')} {part('q')} {part('r')}"), (2, "short."), (2, "")]
    found = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_spans(docs(spark, rows)).collect())
    assert found == sorted([(1, shared, 0), (2, f"{part('x')} {part('y')}\n", 4), *[(i, t, 0) for i, t in rows[2:]]])


def test_passages_at_any_word_go_whole(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(10**6)}" + rng.choice(["", "", "", "", "", "", "", "."])
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    plain = " ".join(f"q{i}" for i in range(51))  # one sentence without an end
    passages = [plain, *[" ".join(word() for _ in range(rng.randint(51, 70))) for _ in range(20)]]
    rows, expected = [], {}
    for k, passage in enumerate(passages):
        rows.append((k, f"{own(rng.randint(0, 45))} {passage} {own(rng.randint(1, 45))}"))
        for j in (100 + k, 200 + k):
            a, b = own(rng.randint(1, 45)), own(rng.randint(1, 45))
            rows.append((j, f"{a} {passage} {b}"))
            expected[j] = f"{a} {b}"
    found = {r["doc_id"]: r for r in dedup_passages(docs(spark, rows)).collect()}
    assert all(found[i]["text"] == (expected.get(i) or t) and (found[i]["n_removed"] > 0) == (i in expected) for i, t in rows)


def test_near_copies_with_one_word_added(spark):
    rng = random.Random(5)
    rows, halves = [], {}
    for k in range(30):
        w = [f"n{k}x{i}" for i in range(64)]
        at = rng.randint(31, 33)
        rows.append((k, "Begin here " + " ".join(w) + " end there"))
        rows.append((100 + k, "Another start " + " ".join([*w[:at], "added", *w[at:]]) + " another end"))
        halves[100 + k] = "Another start added another end"
    found = {r["doc_id"]: r["text"] for r in dedup_passages(docs(spark, rows)).collect()}
    assert all(found[i] == (halves.get(i) or t) for i, t in rows)


def test_passages_nulls_repeats_and_periods(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    text = " ".join(f"a{i}" for i in range(25)) + ".\n" + " ".join(f"b{i}" for i in range(25)) + "."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text), (4, "short."), (5, long), (6, long), (7, "to and fro " * 40), (8, f"{own_}\n{text}" if (own_ := "mine " * 3) else "")]
    found = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_passages(docs(spark, rows)).collect()), key=str)
    periodic = next(t for i, t, _ in found if i == 7)
    assert 20 <= len(periodic.split()) < 26 and ("to and fro " * 40).startswith(periodic.strip())
    rest = [x for x in found if x[0] != 7]
    assert rest == sorted([(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0), (4, "", 4), (4, "short.", 0), (5, long, 0), (6, "", 3000), (8, own_ + "\n", 4)], key=str)
    extra = docs(spark, rows).withColumn("n_removed", F.col("rank"))
    assert dedup_passages(extra).columns.count("n_removed") == 1
    assert dedup_passages(docs(spark, [])).count() == 0
