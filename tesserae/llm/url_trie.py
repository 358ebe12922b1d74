"""URL filter: a trie over reversed host labels and then path segments.

A rule fits its host and all subdomains if the URL's path starts with the rule's path. Among fitting rules the deepest
host wins, then the longest path; of two entries for the same host and path the block entry wins. URLs that no rule
fits get the default verdict.

Rows: one per input row. Null URL or no "://": host and path are empty strings, no rule, default verdict. More columns
of the input are kept where asked for. The trie is broadcast; its size is checked against MAX_RULES.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) entries of the registered query; fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"  # host and path after the first "://"
MAX_RULES = 1_000_000  # about 300 MB as a trie; a longer list is refused


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested dicts by reversed host label. Under "/" a node holds the paths: nested dicts by segment, whose "" holds
    the rules that end inside the next segment as (rest of the path, verdict, rule string)."""
    root: dict = {}
    for n, (verdict, host, path) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault((label,), {})
        node = node.setdefault("/", {})
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.setdefault((segment,), {})
        node.setdefault("", []).append((rest, verdict, host.lower() + path))
    return root


def _deepest(paths: dict, path: str) -> tuple[str, str] | None:
    """The (rule, verdict) of the longest rule path that `path` starts with."""
    best, node, segments = None, paths, path.split("/")
    for i, segment in enumerate(segments):
        tail = [x for x in node.get("", ()) if segment.startswith(x[0])]
        if tail:
            _, verdict, rule = max(tail, key=lambda x: (len(x[0]), x[1] == "block"))
            best = (rule, verdict)
        node = node.get((segment,)) if i < len(segments) - 1 else None
        if node is None:
            break
    return best


def judge(trie: dict, host: str, path: str, default: str = DEFAULT) -> tuple[str | None, str]:
    """(rule or None, verdict)."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get((label,))
        if node is None:
            break
        best = _deepest(node.get("/", {}), path) or best
    return best if best else (None, default)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = tuple(RULES), default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for every row of pages; see the module's text."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = F.regexp_extract(url, URL, 1), F.regexp_extract(url, URL, 2)
    parts = pages.select(F.col(id_col), F.translate(host, upper, lower).alias("host"), path.alias("path"))

    @F.pandas_udf("rule string, verdict string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in batches:
            yield pd.DataFrame([judge(trie.value, h, p, default) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    judged = parts.withColumn("judged", verdicts("host", "path"))
    return judged.select(id_col, "host", "path", "judged.rule", "judged.verdict")
