from __future__ import annotations

import random

from tesserae.llm.url_trie import DEFAULT, RULES, build_trie, filter_urls, judge


def _plain(rules, host, path):
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, DEFAULT)


def test_trie_is_longest_match():
    rng = random.Random(4)
    labels, segments = ["a", "b", "com", "org"], ["", "x", "xy", "1", "12"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3)))) for _ in range(40))}.values())
    trie = build_trie(rules)
    for _ in range(3000):
        host, path = ".".join(rng.choices(labels, k=rng.randint(1, 4))), rng.choice(["", "/" + "/".join(rng.choices(segments, k=rng.randint(0, 4)))])
        assert judge(trie, host, path) == _plain(rules, host, path)


def test_urls(spark):
    rows = [
        (1, "http://EXAMPLE.org/es/1?q=/de/", 3),
        (2, "https://a.example.org/en/12#x", 3),
        (3, "https://a.example.org/en/2", 3),
        (4, "https://notexample.org/es/", 3),
        (5, "http://example.org", 3),
        (6, "http://b.com/de/x", 3),
        (7, "http://b.com?x=/de/", 3),
        (8, None, 3),
        (9, "no scheme/de/", 3),
        (10, "", 3),
        (11, "http://x.com/a://y.org/", 3),
        (12, "http://" + "a." * 5000 + "com/fr/" + "x" * 100_000, 3),
        (None, "http://x.com/fr/É\n1", 3),
        (1, "http://EXAMPLE.org/es/1?q=/de/", 3),
    ]
    found = filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict int"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[4] == ("notexample.org", "/es/", "org/", "allow")
    assert got[5] == ("example.org", "", None, DEFAULT)
    assert got[6] == ("b.com", "/de/x", "com/de/", "block")
    assert got[7] == ("b.com", "", None, DEFAULT)
    assert got[8] == got[9] == got[10] == ("", "", None, DEFAULT)
    assert got[11] == ("x.com", "/a://y.org/", None, DEFAULT)
    assert got[12][2:] == ("com/fr/", "allow")
    assert got[None] == ("x.com", "/fr/É\n1", "com/fr/", "allow")
    assert all(_plain(RULES, h, p) == (r, v) for h, p, r, v in got.values())
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
