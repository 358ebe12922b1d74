"""Patterns: their translation to regular expressions, counts and cycles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for single characters of a pattern outside brackets.
_SINGLE = {"(": "{", ")": "}", "{": "[^", "}": "]", "x": ".", "-": "", "B": "[NDB]", "z": "[QEZ]", ">": "$"}


def to_regex(pattern: str) -> str:
    """The regular expression of a pattern, without its closing full stop.

    Round brackets give counts, curly ones exclude; x is any letter; a bracketed set that holds < or > also fits the
    start or the end. A < outside a set is copied.
    """
    out, i = [], 0
    pattern = pattern.strip().removesuffix(".")
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.index("]", i)
            letters = pattern[i + 1 : end].replace("B", "NDB").replace("z", "QEZ")
            if "<" in letters:
                out.append(f"(?:^|[{letters.replace('<', '')}])")
            elif ">" in letters:
                out.append(f"(?:[{letters.replace('>', '')}]|$)")
            else:
                out.append(f"[{letters}]")
            i = end
        else:
            out.append(_SINGLE.get(c, c))
        i += 1
    return "".join(out)


def count(seq: Column, regex: str) -> Column:
    """Number of matches that do not overlap."""
    return F.regexp_count(seq, F.lit(regex)).cast("long")


def cycles(seq: Column, regex: str, width: int) -> Column:
    """The most times in a row that a pattern of a fixed width matches."""
    runs = F.regexp_extract_all(seq, F.lit(f"(?:{regex})+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r) / width)), F.lit(0)).cast("long")


def matches(seq: Column, regex: str) -> Column:
    """The matched texts, first to last."""
    return F.regexp_extract_all(seq, F.lit(regex), F.lit(0))


def valid(regex: str) -> bool:
    """Whether Python, too, can read the expression."""
    try:
        re.compile(regex)
    except re.error:
        return False
    return True
