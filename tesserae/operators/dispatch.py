"""One entry for what a search may end in, which refuses combinations that make no sense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import heatmap
from ..sources.profiles import Profile
from . import aggregates
from .search import cell_matrix, search

OUTPUTS = ("hits", "histogram", "density", "data", "png")


def guard(output: str, profile: Profile, cycle_range: tuple[int, int] | None = None, on_cycles: bool = False) -> None:
    """Fail for an output that the other options rule out."""
    if output not in OUTPUTS:
        raise ValueError(f"output {output!r} is none of {OUTPUTS}")
    if output == "histogram" and on_cycles and cycle_range is None:
        raise ValueError("a histogram of cycles needs a range of cycles")
    if output in ("density", "data", "png") and profile.type != "MATRIX":
        raise ValueError(f"{output} needs a matrix, not a pattern")
    if on_cycles and output not in ("histogram", "density"):
        raise ValueError(f"{output} has no form by cycles")


def report(sequences: DataFrame, profile: Profile, output: str = "hits", score_range: tuple[int, int] | None = None, cycle_range: tuple[int, int] | None = None, on_cycles: bool = False, clip: tuple[int, int] | None = None, key: str = "seq_id", text: str = "raw", **options) -> DataFrame:
    """Hits, a histogram of the best scores (on_cycles: of their cycles), their density, the cells, or tiles of the cells.

    Histograms and densities need ranges: of scores, and of cycles for those that count cycles; clip leaves out what lies
    at a border. Further options are those of search.
    """
    guard(output, profile, cycle_range, on_cycles)
    if output == "hits":
        return search(sequences, [profile], score_range=score_range, cycle_range=cycle_range, clip=clip, key=key, text=text, **options)
    if output in ("data", "png"):
        cells = cell_matrix(sequences, profile, key=key, text=text)
        return cells if output == "data" else heatmap.tiles(cells, key=key, **options)
    if score_range is None and not on_cycles or output == "density" and cycle_range is None:
        raise ValueError(f"a {output} needs its ranges")
    best = search(sequences, [profile], top=1, key=key, text=text, paths=False, **options)
    best = best if clip is None else best.where(~aggregates.near_border(F.col("seq_begin"), F.col("seq_end"), F.col("seq_len"), clip))
    score, cycles = F.col("score"), F.col("cycles")
    if output == "density":
        return aggregates.density(best, score, cycles, (score_range[0], score_range[1] + 1), (cycle_range[0], cycle_range[1] + 1))
    if on_cycles:
        return aggregates.cycle_histogram(best, score, cycles, *cycle_range, score_range)
    own = best if cycle_range is None else best.where(cycles.between(*cycle_range))
    return aggregates.histogram(own, score, *score_range)


def zmw_histogram(scores: DataFrame, low: int, high: int, score: str = "score", cycles: Column | None = None, cycle_range: tuple[int, int] | None = None) -> DataFrame:
    """bin, n of the best subread of each hole: rows of hole, region, score; with cycles only those in a range count."""
    from .holes import best_subread

    best = best_subread(scores, score)
    if cycles is not None:
        return aggregates.histogram_with_cycles(best, F.col(score), cycles, low, high, cycle_range)
    return aggregates.histogram(best, F.col(score), low, high)
