"""Scores of short profiles inside the JVM, as folds over the residues; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.profiles import NLOW, D, I, M, Profile, X
from .kernels import Kernel, heuristic_table


def heuristic(seq: Column, profile: Profile) -> Column:
    """The ungapped heuristic score: a fold that keeps the last runs and the best run of each position."""
    table, n = heuristic_table(profile), profile.length
    letters = " " + profile.alphabet
    score = F.create_map(*[x for i, c in enumerate(letters) if c != " " for x in (F.lit(c), F.array(*[F.lit(int(v)) for v in table[:, i]]))])
    unknown = F.array(*[F.lit(int(v)) for v in table[:, 0]])
    residues = F.filter(F.split(seq, ""), lambda c: c != "")
    first = F.array(*[F.lit(0)] * n)
    state = F.struct(first.alias("v"), first.alias("best"), F.lit(True).alias("start"))

    def step(a: Column, c: Column) -> Column:
        own = F.coalesce(F.try_element_at(score, c), unknown)
        runs = [own[j] + (a["v"][j - 1] if j else 0) for j in range(n)]
        v = [F.when(a["start"], own[j]).otherwise(F.greatest(F.lit(0), runs[j])) for j in range(n)]
        best = [F.when(a["start"], own[j]).otherwise(F.greatest(a["best"][j], runs[j], F.lit(0))) for j in range(n)]
        return F.struct(F.array(*v).alias("v"), F.array(*best).alias("best"), F.lit(False).alias("start"))

    return F.aggregate(residues, state, step, lambda a: F.aggregate(a["best"], F.lit(0), lambda s, x: s + x))


def best_score(seq: Column, profile: Profile) -> Column:
    """The best standard alignment score of a profile of a few positions; null for an empty sequence.

    The fold keeps the match and insertion scores of a row; the deletion chain is a second fold over the positions, so
    the expression grows with the length of the profile, not exponentially.
    """
    kernel, n = Kernel(profile), profile.length
    no = int(-(1 << 30))
    letters = profile.alphabet
    lit = lambda values: F.array(*[F.lit(int(v)) for v in values])
    of = lambda table: F.create_map(*[x for i, c in enumerate(letters, 1) for x in (F.lit(c), lit(table[i]))])
    match, insertion = of(kernel.match), of(kernel.insertion)
    to = {k: lit(v) for k, v in kernel.to.items()}
    last = {s: lit(kernel.last[:, s]) for s in (M, I, D)}
    delete = lit(kernel.delete)
    start = kernel.start(1)
    residues = F.filter(F.split(seq, ""), lambda c: c != "")
    columns = F.sequence(F.lit(0), F.lit(n))
    size = F.size(residues)
    state = F.struct(lit(start[M][0]).alias("m"), lit(start[I][0]).alias("i"), F.lit(no).alias("best"), F.lit(0).alias("row"))
    empty = F.array().cast("array<int>")

    def step(a: Column, c: Column) -> Column:
        own = F.coalesce(F.try_element_at(match, c), lit(kernel.match[0]))
        ins = F.coalesce(F.try_element_at(insertion, c), lit(kernel.insertion[0]))
        end = a["row"] + 1 == size
        zero = F.struct(empty.alias("m"), empty.alias("i"), F.lit(no).alias("d"), F.lit(no).alias("best"))

        def column(b: Column, j: Column) -> Column:
            inputs = F.struct(
                F.when(j > 0, F.element_at(a["m"], F.greatest(j, F.lit(1))) + F.element_at(own, F.greatest(j, F.lit(1)))).otherwise(no).alias("km"),
                (a["i"][j] + ins[j]).alias("ki"),
                F.when(j > 0, b["d"] + delete[j]).otherwise(no).alias("kd"),
            )

            def cell(k: Column) -> Column:
                value = lambda t: F.greatest(k["km"] + to[M, t][j], k["ki"] + to[I, t][j], k["kd"] + to[D, t][j], to[X, t][j])
                out = lambda s: F.when(end, last[s][j]).otherwise(to[s, X][j])
                leave = F.greatest(k["km"] + out(M), k["ki"] + out(I), k["kd"] + out(D), F.lit(NLOW))
                return F.struct(F.array_append(b["m"], value(M)).alias("m"), F.array_append(b["i"], value(I)).alias("i"), value(D).alias("d"), F.when(j > 0, F.greatest(b["best"], leave)).otherwise(b["best"]).alias("best"))

            return F.transform(F.array(inputs), cell)[0]

        row = F.aggregate(columns, zero, column)
        return F.transform(F.array(row), lambda r: F.struct(r["m"].alias("m"), r["i"].alias("i"), F.greatest(a["best"], r["best"]).alias("best"), (a["row"] + 1).alias("row")))[0]

    return F.when(size > 0, F.aggregate(residues, state, step, lambda a: a["best"]))
