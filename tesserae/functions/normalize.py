"""Raw and normalised scores, and average-frequency weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINEAR, ZSCORE, ZSCORE_AVERAGE = "LINEAR", "GLE_ZSCORE", "GLE_ZSCAVE"


def to_normalized(raw: Column, function: str, r: Sequence[float], length: Column | None = None, average: Column | None = None, strict: bool = False) -> Column:
    """A raw score's normalised value, as a double.

    strict: divide by r[0] in the length-dependent functions, which inverts `to_raw` exactly; by default it is left out.
    """
    raw = raw.cast("double")
    if function == LINEAR:
        return r[0] + r[1] * raw
    if function == ZSCORE_AVERAGE:
        raw = raw - average
    value = raw / (1.0 - F.exp(r[1] * length - r[2]))
    return ((value / r[0] if strict else value) - r[3]) / r[4]


def to_raw(norm: Column, function: str, r: Sequence[float], length: Column | None = None, average: Column | None = None) -> Column:
    """The raw score of a normalised one, rounded by adding a half and cutting."""
    norm = norm.cast("double")
    if function == LINEAR:
        return ((norm - r[0]) / r[1] + 0.5).cast("int")
    value = r[0] * (1.0 - F.exp(r[1] * length - r[2])) * (r[4] * norm + r[3])
    if function == ZSCORE_AVERAGE:
        value = value + average
    return (value + 0.5).cast("int")


def heuristic_cutoff(cutoff: Column, r: Sequence[float]) -> Column:
    """The heuristic score of a cut-off."""
    return (cutoff * r[1] + r[0] + 0.5).cast("int")


def average_weights(profile) -> list[int]:
    """Each letter's match scores summed over a profile's positions, by alphabet position from 0 (undeclared letters)."""
    return [int(x) for x in profile.match[:, : 1 + len(profile.alphabet)].sum(axis=0)]


def average_score(encoded: Column, weights: Sequence[int]) -> Column:
    """Mean over a sequence of its letters' weights; encoded: alphabet positions, weights by position from 0. Empty: 0."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(encoded, F.lit(0.0), lambda a, x: a + w[x])
    return F.when(F.size(encoded) > 0, total / F.size(encoded)).otherwise(F.lit(0.0))


def average_of_text(text: Column, alphabet: str, weights: Sequence[int]) -> Column:
    """As average_score, of a cleaned sequence itself: each letter is counted by what its removal leaves, no array is made. Null stays null."""
    n = F.length(text)
    total = n.cast("double") * float(weights[0])
    for letter, w in zip(alphabet, weights[1:], strict=True):
        if w != weights[0]:
            total = total + (n - F.length(F.replace(text, F.lit(letter), F.lit("")))) * float(w - weights[0])
    return F.when(n > 0, total / n).when(n == 0, F.lit(0.0))
