"""Profile search over a table of sequences.

Sequences are cleaned in the JVM, only (key, sequence) crosses to Python in Arrow batches, and the score bound and the
number of wanted hits go into the kernel, so what is below the bound is never made. Profiles are small and travel with
the task. There is no shuffle; a sequence is one row and is worked on alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import to_normalized
from ..functions.sequence import clean, reverse_complement
from ..sources.profiles import D, I, M, Profile
from .kernels import MAP_SCORES, Alignment, Kernel, heuristic_score, heuristic_table, tag_profile
from .stretches import NO, Stretches, settle

_HIT = "profile_id int, rank int, orientation int, score int, cycles int, row_begin int, row_end int, col_begin int, col_end int, seq_begin int, seq_end int, prf_begin int, prf_end int, ipmb int, ipme int, states string, aligned string, seq_len int"
_NAMES = [x.split()[0] for x in _HIT.split(", ")]
_KIND = {"int": pa.int32(), "string": pa.string()}
_TYPES = [_KIND[x.split()[1]] for x in _HIT.split(", ")]


def accepts(found: Alignment, n: int, cutoff: int, score_range: tuple[int, int] | None, cycle_range: tuple[int, int] | None, clip: tuple[int, int] | None, invert: bool, top: bool) -> bool:
    """Whether an alignment counts: the cut-off, or instead of it the conjunction of the given ranges, or its opposite."""
    if score_range is None and cycle_range is None and clip is None:
        return top or found.score >= cutoff
    good = score_range is None or score_range[0] <= found.score <= score_range[1]
    good &= cycle_range is None or cycle_range[0] <= found.cycles <= cycle_range[1]
    good &= clip is None or (found.seq_begin >= clip[0] and found.seq_end + clip[1] <= n)
    return good != invert


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows of few files out to all cores by their key and text; an alignment costs far more than moving its sequence."""
    if rows.isStreaming:
        return rows
    cores, files = rows.sparkSession.sparkContext.defaultParallelism, len(rows.inputFiles())
    return rows.repartition(4 * cores, F.col(key), F.xxhash64("_seq")) if 0 < files < cores else rows


def search(
    sequences: DataFrame,
    profiles: Sequence[Profile],
    cutoff: int | None = None,
    top: int | None = None,
    both_strands: bool = False,
    best_strand: bool = False,
    score_range: tuple[int, int] | None = None,
    cycle_range: tuple[int, int] | None = None,
    clip: tuple[int, int] | None = None,
    invert: bool = False,
    model: str | None = None,
    key: str = "seq_id",
    text: str = "raw",
    paths: bool = True,
) -> DataFrame:
    """Alignments of every sequence with every profile: the key, one row for each, best first.

    cutoff: by default each profile's level 0. top: the most alignments of a strand; without ranges it also lifts the
    cut-off. both_strands: the reverse complement too, its ranks going on. best_strand: only the strand that scores
    more, forward on a tie. paths: without them only the places are found, begins being carried beside the scores, and
    states and aligned are empty. Null or empty sequences give no row. The key may not bear the name of a result column.
    """
    _own_name(key)
    kernels = [Kernel(p, model) for p in profiles]
    cutoffs = [p.level(0)["score"] if cutoff is None else cutoff for p in profiles]
    bounds = [score_range[0] if score_range else (-(1 << 30) if top else c) for c in cutoffs]
    ranges = score_range is not None or cycle_range is not None or clip is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            names, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            strands = {1: texts} if not (both_strands or best_strand) else {1: texts, -1: [x[::-1].translate(_SWAP) for x in texts]}
            made = []
            for pid, kernel in enumerate(kernels):
                keep = lambda a, n, c=cutoffs[pid]: accepts(a, n, c, score_range, cycle_range, clip, invert, top is not None)
                made.append({o: kernel.many_hits(own, bounds[pid], top, keep if ranges else None, paths=paths) for o, own in strands.items()})
            keys, rows = [], []
            for i, (name, forward) in enumerate(zip(names, texts, strict=True)):
                for pid, by_strand in enumerate(made):
                    found = [(o, own[i]) for o, own in by_strand.items()]
                    if best_strand and len(found) == 2:
                        score = [h[0].score if h else -(1 << 31) for _, h in found]
                        found = [found[1] if score[1] > score[0] else found[0]]
                    hits = [(o, h) for o, own in found for h in own]
                    keys += [name] * len(hits)
                    rows += [(pid, rank, o, *vars(h).values(), len(forward)) for rank, (o, h) in enumerate(hits, 1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
            own = pa.array(keys, batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], names=[key, *_NAMES])

    kind = sequences.schema[key].dataType.simpleString()
    rows = spread(sequences.select(F.col(key), clean(F.col(text)).alias("_seq")), key)
    return rows.mapInArrow(run, f"`{key}` {kind}, {_HIT}")


def _own_name(key: str, names: Sequence[str] = tuple(_NAMES)) -> None:
    if key in names:
        raise ValueError(f"a key named {key!r} meets a result column of that name; rename it")


_SWAP = str.maketrans("ACGT", "TGCA")


LETTERS = 1 << 20  # of the sequences that are scored side by side


def portions(batch: pa.RecordBatch, column: int | str = 1, letters: int = LETTERS) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many letters, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def best_scores(sequences: DataFrame, profiles: Sequence[Profile], both_strands: bool = False, model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, profile_id, orientation, score: the best score alone, many sequences side by side; no cells are kept."""
    _own_name(key, ("profile_id", "orientation", "score"))
    kernels = [Kernel(p, model) for p in profiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            forward = [x or "" for x in batch.column(1).to_pylist()]
            for pid, kernel in enumerate(kernels):
                n = len(forward)
                both = forward + [x[::-1].translate(_SWAP) for x in forward] if both_strands else forward
                scores = kernel.best_scores([kernel.encode(x) for x in both])  # both strands side by side
                for orientation, score in ((1, scores[:n]), (-1, scores[n:])) if both_strands else ((1, scores),):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pid] * n, pa.int32()), pa.array([orientation] * n, pa.int32()), pa.array(score, pa.int32())], names=[key, "profile_id", "orientation", "score"])

    kind = sequences.schema[key].dataType.simpleString()
    rows = spread(sequences.select(F.col(key), clean(F.col(text)).alias("_seq")), key)
    return rows.mapInArrow(run, f"`{key}` {kind}, profile_id int, orientation int, score int")


def long_scores(sequences: DataFrame, profile: Profile, model: str | None = None, key: str = "seq_id", text: str = "raw", size: int = 1 << 18) -> DataFrame:
    """key, score: as best_scores of one profile, with sequences cut into stretches of so many letters over all tasks.

    A stretch first runs from no alignment, and hands the row after it to the next, which runs again from there until its
    rows are those it had. Only if a row after changes again is a sequence scored in one task. Null and empty sequences
    have NLOW; keys must be distinct and not null.
    """
    _own_name(key, ("score",))
    kernel = Kernel(profile, model)
    wide = 2 * (kernel.length + 1)
    kind = sequences.schema[key].dataType.simpleString()
    rows = sequences.select(F.col(key).alias("_k"), F.coalesce(clean(F.col(text)), F.lit("")).alias("_seq"))
    count = F.greatest(F.ceil(F.length("_seq") / F.lit(size)).cast("int"), F.lit(1))
    pieces = rows.select("_k", count.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("_seq"), i * size + 1, F.lit(size)))).alias("_piece", "_part"))
    schema = f"_k {kind}, _piece int, _last boolean, _part string, best long, after binary, before binary"

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in portions(big, "_part"):
                n, piece = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_n", "_piece"))
                parts = batch.column("_part").to_pylist()
                own = [kernel.encode(x) for x in parts]
                starts = np.full((len(own), 2, kernel.length + 1), NO)
                starts[piece == 0] = [kernel.start(1)[s][0] for s in (M, I)]
                run = Stretches(kernel, own, None, starts, piece == n - 1)
                best = run.best()
                after = run.after().reshape(len(own), wide)
                names, last = batch.column("_k"), piece == n - 1
                # a first piece never runs again, so only its score goes on
                blob = [None if f and e else a.astype("<i8").tobytes() for a, f, e in zip(after, piece == 0, last, strict=True)]
                kept = [None if f else x for x, f in zip(parts, piece == 0, strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(piece, pa.int32()), pa.array(last), pa.array(kept, pa.string()), pa.array(best, pa.int64()), pa.array(blob, pa.binary()), pa.nulls(len(own), pa.binary())], names=["_k", "_piece", "_last", "_part", "best", "after", "before"])
                on = np.flatnonzero(~last)
                none = pa.nulls(len(on))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(on)), pa.array(piece[on] + 1, pa.int32()), none.cast(pa.bool_()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([blob[j] for j in on.tolist()], pa.binary())], names=["_k", "_piece", "_last", "_part", "best", "after", "before"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in portions(big, "_part"):
                best, last = batch.column("best").to_numpy(zero_copy_only=False).copy(), batch.column("_last").to_numpy(zero_copy_only=False).astype(bool)
                later = np.flatnonzero(batch.column("before").is_valid().to_numpy(zero_copy_only=False))
                changed = np.zeros(len(best), bool)
                if len(later):
                    parts = batch.column("_part").take(pa.array(later)).to_pylist()
                    before, after = (np.stack([np.frombuffer(x, "<i8") for x in batch.column(c).take(pa.array(later)).to_pylist()]).reshape(len(later), 2, -1) for c in ("before", "after"))
                    best[later], changed[later] = settle(kernel, [kernel.encode(x) for x in parts], before, after, last[later], best[later])
                yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(best, pa.int64()), pa.array(changed & ~last)], names=["_k", "best", "open"])

    cores = sequences.sparkSession.sparkContext.defaultParallelism
    made = pieces.repartition(4 * cores, "_k", "_piece").mapInArrow(fresh, schema)
    joined = made.groupBy("_k", "_piece").agg(*[F.max(c).alias(c) for c in ("_last", "_part", "best", "after", "before")])
    found = joined.mapInArrow(again, f"_k {kind}, best long, open boolean").groupBy("_k").agg(F.max("best").alias("score"), F.max("open").alias("open")).persist()
    rest = best_scores(rows.join(found.where("open").select("_k"), "_k", "left_semi"), [profile], model=model, key="_k", text="_seq")
    return found.where("not open").select(F.col("_k").alias(key), F.col("score").cast("int").alias("score")).unionByName(rest.select(F.col("_k").alias(key), "score"))


def best_cycles(sequences: DataFrame, profile: Profile, key: str = "seq_id", text: str = "raw", insertion_wraps: bool = False) -> DataFrame:
    """key, score, cycles, begin, end: the best alignment, the last one on a tie; wraps from an insertion count as a cycle only on demand.

    begin and end are rows of the matrix: the residues begin to end - 1. Null and empty sequences give no row.
    """
    _own_name(key, ("score", "cycles", "begin", "end"))
    kernel = Kernel(profile, insertion_wraps=insertion_wraps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kernel.many_hits([x or "" for x in batch.column(1).to_pylist()], -(1 << 30), 1, paths=False)
            rows = [(i, h.score, h.cycles, h.row_begin, h.row_end) for i, own in enumerate(found) for h in own]
            at, *columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int32()) for c in columns]], names=[key, "score", "cycles", "begin", "end"])

    kind = sequences.schema[key].dataType.simpleString()
    return spread(sequences.select(F.col(key), clean(F.col(text)).alias("_seq")), key).mapInArrow(run, f"`{key}` {kind}, score int, cycles int, begin int, end int")


def best_strand(scores: DataFrame, key: str = "seq_id") -> DataFrame:
    """The better strand of each sequence and profile; forward wins ties."""
    order = F.struct(F.col("score"), F.col("orientation"))
    return scores.groupBy(key, "profile_id").agg(F.max(order).alias("b")).select(key, "profile_id", "b.orientation", "b.score")


def with_norm(hits: DataFrame, profile: Profile, mode: int = 1, length: Column | None = None) -> DataFrame:
    """Hits of one profile with norm_score; length-dependent functions take the length of the printed text."""
    norm = profile.mode(mode)
    value = to_normalized(F.col("score"), norm["function"], norm["r"], F.length("aligned") if length is None else length, F.lit(0.0))
    return hits.withColumn("norm_score", value.cast("float"))


def _matrix_frame(sequences: DataFrame, key: str, text: str, columns: str, made) -> DataFrame:
    """Rows that `made` makes of each batch's encoded sequences: (positions of the sequences, arrays of the columns)."""
    names = [c.split()[0] for c in columns.split(", ")]
    _own_name(key, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, arrays in made([x or "" for x in batch.column(1).to_pylist()]):
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *arrays], names=[key, *names])
                yield from (out.slice(at, _SLICE) for at in range(0, len(out), _SLICE))

    kind = sequences.schema[key].dataType.simpleString()
    rows = spread(sequences.select(F.col(key), clean(F.col(text)).alias("_seq")), key)
    return rows.mapInArrow(run, f"`{key}` {kind}, {columns}")


_SLICE = 1 << 18  # rows of a batch of cells


def _places(own: np.ndarray, size: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lane, row) of every row of a group of matrices, and (row, column) of every cell."""
    lane = np.repeat(np.arange(len(own)), size + 1)
    row = np.arange(len(lane)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return lane, row, np.repeat(row, columns).astype(np.int32), np.tile(np.arange(columns, dtype=np.int32), len(row))


_CELL = "seq int, prf int, match int, insertion int, deletion int"


def cell_matrix(sequences: DataFrame, profile: Profile, model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, seq, prf, match, insertion, deletion: every cell of each sequence's matrix."""
    kernel = Kernel(profile, model)

    def made(texts: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for own, size, scores in kernel.scored([kernel.encode(x) for x in texts]):
            lane, row, seq, prf = _places(own, size, kernel.length + 1)
            flat = scores[lane, row].reshape(-1, 4)
            yield np.repeat(own[lane], kernel.length + 1), [pa.array(x) for x in (seq, prf, *(np.ascontiguousarray(flat[:, s]) for s in (M, I, D)))]

    return _matrix_frame(sequences, key, text, _CELL, made)


def mirror_matrix(sequences: DataFrame, profile: Profile, mirror: Profile, model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, seq, prf, match, insertion, deletion: every cell plus that of the reversed sequence and profile at the mirrored place.

    As aggregates.matrix_sum of two tables of cells, but both matrices of a sequence are made, and added, in one place.
    """
    kernel, back = Kernel(profile, model), Kernel(mirror, model)
    if kernel.length != back.length:
        raise ValueError("the profiles differ in length")

    def made(texts: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        both = zip(kernel.scored([kernel.encode(x) for x in texts]), back.scored([back.encode(x)[::-1] for x in texts]), strict=True)
        for (own, size, scores), (_, _, mirrored) in both:
            lane, row, seq, prf = _places(own, size, kernel.length + 1)
            flat = (scores[lane, row] + mirrored[lane, size[lane] - row, ::-1]).reshape(-1, 4)
            yield np.repeat(own[lane], kernel.length + 1), [pa.array(x) for x in (seq, prf, *(np.ascontiguousarray(flat[:, s]) for s in (M, I, D)))]

    return _matrix_frame(sequences, key, text, _CELL, made)


def matrix_rows(sequences: DataFrame, profile: Profile, state: str = "match", model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, seq, values: one state's scores of each matrix row; forbidden ones are -32767. As sinks.rows_of, without a shuffle of cells."""
    kernel, at = Kernel(profile, model), {"match": M, "insertion": I, "deletion": D}[state]

    def made(texts: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for own, size, scores in kernel.scored([kernel.encode(x) for x in texts]):
            lane, row, _, _ = _places(own, size, kernel.length + 1)
            values = scores[lane, row, :, at]
            ends = np.arange(len(row) + 1, dtype=np.int32) * np.int32(kernel.length + 1)
            yield own[lane], [pa.array(row.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.where(values <= -16383, -32767, values).astype(np.int32).ravel()))]

    return _matrix_frame(sequences, key, text, "seq int, values array<int>", made)


def matrix_extrema(sequences: DataFrame, profile: Profile, model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """The least and greatest score of each state of each sequence's matrix. As aggregates.matrix_extrema, without a row a cell."""
    kernel = Kernel(profile, model)

    def made(texts: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for own, size, scores in kernel.scored([kernel.encode(x) for x in texts]):
            lane, row, _, _ = _places(own, size, kernel.length + 1)
            flat, first = scores[lane, row], np.cumsum(size + 1) - size - 1
            least, most = np.minimum.reduceat(flat.min(axis=1), first), np.maximum.reduceat(flat.max(axis=1), first)
            yield own, [pa.array(np.ascontiguousarray(x[:, s])) for s in (M, I, D) for x in (least, most)]

    return _matrix_frame(sequences, key, text, ", ".join(f"{f}_{c} int" for c in ("match", "insertion", "deletion") for f in ("min", "max")), made)


def matrix_pixels(sequences: DataFrame, profile: Profile, levels: int, floor: int | None = None, model: str | None = None, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, zoom, y, x, value: the greatest match score, floor at least, behind each pixel at each level of zoom.

    As heatmap.pixels of a table of cells, but each sequence's matrix is shrunk where it is made.
    """
    kernel = Kernel(profile, model)

    def made(texts: list[str]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for own, size, scores in kernel.scored([kernel.encode(x) for x in texts]):
            value, rows = scores[..., M], size + 1
            value = np.where((np.arange(value.shape[1]) < rows[:, None])[..., None], value if floor is None else np.maximum(value, floor), np.iinfo(np.int32).min)
            for zoom in range(levels):
                if zoom:
                    value = np.pad(value, ((0, 0), (0, value.shape[1] % 2), (0, value.shape[2] % 2)), constant_values=np.iinfo(np.int32).min)
                    value = value.reshape(len(own), value.shape[1] // 2, 2, value.shape[2] // 2, 2).max(axis=(2, 4))
                    rows = (rows + 1) // 2
                lane, row, y, x = _places(own, rows - 1, value.shape[2])
                found = value[lane, row].ravel().astype(np.int32)
                yield np.repeat(own[lane], value.shape[2]), [pa.array(c) for c in (np.full(len(found), zoom, np.int32), y, x, found)]

    return _matrix_frame(sequences, key, text, "zoom int, y int, x int, value int", made)


def map_tags(genomes: DataFrame, tags: Sequence[tuple[str, str]], scores: dict = MAP_SCORES, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, tag, begin, end, score: the best place of each whole tag in each sequence, the first one on a tie.

    begin and end count from 0. Begins are carried beside the scores, so no cells are kept.
    """
    _own_name(key, ("tag", "begin", "end", "score"))
    kernels = [(name, Kernel(tag_profile(tag, scores))) for name, tag in tags if tag]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            found = [(tag, kernel.many_hits(texts, -(1 << 30), 1, first=True, paths=False)) for tag, kernel in kernels]
            rows = [(name, tag, h.seq_begin, h.seq_end, h.score) for i, name in enumerate(names) for tag, own in found for h in own[i]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "tag", "begin", "end", "score"])

    kind = genomes.schema[key].dataType.simpleString()
    return spread(genomes.select(F.col(key), clean(F.col(text)).alias("_seq")), key).mapInArrow(run, f"`{key}` {kind}, tag string, begin int, end int, score int")


def heuristic_scores(sequences: DataFrame, profile: Profile, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """key, heuristic: the ungapped score of each sequence, a cheap (and lossy) test before an alignment."""
    table, lut = heuristic_table(profile), Kernel(profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [heuristic_score(table, lut.encode(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.int32())], names=[key, "heuristic"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(F.col(key), clean(F.col(text)).alias("_seq")).mapInArrow(run, f"`{key}` {kind}, heuristic int")


def classify(hits: DataFrame, profiles: Sequence[Profile], key: str = "seq_id") -> DataFrame:
    """Hits with the sub-profile that scores the aligned letters best: class_id and class_score; the first on a tie."""
    parts = hits.withColumn("_hit", F.struct(key, "profile_id", "rank")).withColumn("_letters", F.regexp_replace("aligned", "-", ""))
    scored = best_scores(parts, profiles, key="_hit", text="_letters")
    best = scored.groupBy("_hit").agg(F.max(F.struct(F.col("score"), (-F.col("profile_id")).alias("p"))).alias("b"))
    best = best.select(F.col("_hit." + key).alias("_k"), F.col("_hit.profile_id").alias("_p"), F.col("_hit.rank").alias("_r"), (-F.col("b.p")).alias("class_id"), F.col("b.score").alias("class_score"))
    return hits.join(best, hits[key].eqNullSafe(F.col("_k")) & (hits["profile_id"] == F.col("_p")) & (hits["rank"] == F.col("_r"))).drop("_k", "_p", "_r")


def level_tags(profile: Profile, score: Column, strict: bool = False) -> Column:
    """The level of the first cut-off that a score reaches (strict: exceeds), else one less than the last level read."""
    value, last = None, 0
    for item in profile.cutoff:
        met = score > item["score"] if strict else score >= item["score"]
        value = F.when(met, item["level"]) if value is None else value.when(met, item["level"])
        last = item["level"]
        if item["level"] == 0 and item["score"] == 0:
            break
    return value.otherwise(last - 1)


def extract(sequences: DataFrame, hits: DataFrame, what: str, key: str = "seq_id", text: str = "raw") -> DataFrame:
    """Parts of the sequences that hits point to: source, before, after or between.

    source: the whole sequence of the best hit. before and after: what lies beside each hit. between: the gaps of a
    sequence's hits, with what lies before the first and after the last.
    """
    seqs = sequences.select(F.col(key).alias("_k"), clean(F.col(text)).alias("_fwd"))
    strand = F.when(F.col("orientation") == -1, reverse_complement(F.col("_fwd"))).otherwise(F.col("_fwd"))
    both = hits.join(seqs, hits[key].eqNullSafe(F.col("_k"))).withColumn("_seq", strand)
    part = lambda a, n: F.when(n > 0, F.substring(F.col("_seq"), a + 1, n)).otherwise("")
    if what == "source":
        best = Window.partitionBy(key, "profile_id").orderBy(F.desc("score"), "rank")
        return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(key, "profile_id", F.lit(1).alias("part"), F.col("_seq").alias("text"))
    if what == "before":
        return both.select(key, "profile_id", F.col("rank").alias("part"), part(F.lit(0), F.col("seq_begin") - 1).alias("text"))
    if what == "after":
        return both.select(key, "profile_id", F.col("rank").alias("part"), part(F.col("seq_end") + 1, F.col("seq_len") - F.col("seq_end") - 1).alias("text"))
    if what != "between":
        raise ValueError(f"extract {what!r}")
    order = Window.partitionBy(key, "profile_id").orderBy("seq_begin", "rank")
    gaps = both.withColumn("_n", F.row_number().over(order)).withColumn("_from", F.coalesce(F.lag("seq_end").over(order) + 1, F.lit(0)))
    gaps = gaps.withColumn("_last", F.lead("seq_end").over(order).isNull())
    tail = F.when(F.col("_last"), F.struct((F.col("_n") + 1).alias("part"), (F.col("seq_end") + 1).alias("a"), (F.col("seq_len") - F.col("seq_end") - 1).alias("n")))
    head = F.struct(F.col("_n").alias("part"), F.col("_from").alias("a"), (F.col("seq_begin") - F.col("_from")).alias("n"))
    return gaps.withColumn("g", F.explode(F.filter(F.array(head, tail), lambda x: x.isNotNull() & (x["n"] > 0)))).select(key, "profile_id", "g.part", part(F.col("g.a"), F.col("g.n")).alias("text"))
