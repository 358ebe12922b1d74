"""DuckDB SQL of alignments, for the oracles: the recursion by residues with its paths carried along.

Every cell is a struct (score, rank of the step into it, row and column of entry, states, aligned letters). The greater
struct wins, so scores come first and ties go by rank: entry, insertion, match, deletion. Steps that a model forbids are
left out.
"""

from __future__ import annotations

from dataclasses import dataclass

GAP = "'-'"


@dataclass(frozen=True)
class Model:
    """Scores of a word's profile; enter_match, enter_delete, leave_match and leave_delete by column, None: forbidden."""

    word: str
    letter: str  # SQL of a residue's score; {c} is the word's letter, {x} the residue
    mm: int = 0
    mi: int = 0
    md: int = 0
    insertion: int = -3
    deletion: int = -3
    local: bool = True

    def enter_match(self, c: int) -> int | None:
        return 0 if c == 0 or self.local and c < len(self.word) else None

    def enter_delete(self, c: int) -> int | None:
        return None if self.local or c else -2

    def leave_match(self, c: int) -> int | None:
        return 0 if self.local else 1 if c == len(self.word) else None

    def leave_delete(self, c: int) -> int | None:
        return None if self.local or c < len(self.word) else 0


def _entry(score: int, row: str, col: int) -> str:
    return f"{{'s': {score}, 'r': 3, 'b': {row}, 'e': {col}, 'st': 'X', 'al': ''}}"


def _step(cell: str, score: str, rank: int, state: str, aligned: str) -> str:
    return f"{{'s': {cell}.s + ({score}), 'r': {rank}, 'b': {cell}.b, 'e': {cell}.e, 'st': {cell}.st || '{state}', 'al': {cell}.al || {aligned}}}"


def _plus(cell: str, score: int) -> str:
    return f"{{'s': {cell}.s + ({score}), 'r': {cell}.r, 'b': {cell}.b, 'e': {cell}.e, 'st': {cell}.st, 'al': {cell}.al}}" if score else cell


def _best(options: list[str]) -> str:
    return options[0] if len(options) == 1 else f"greatest({', '.join(options)})"


def ends(source: str, key: str, p: Model) -> str:
    """SQL of key, raw, row, score, col, begin, entry, states, aligned: the best alignment that ends at each residue."""
    n, no = len(p.word), "{'s': -9999, 'r': 2, 'b': 0, 'e': 0, 'st': '', 'al': ''}"

    def cells(row: str, first: bool) -> tuple[list[str], list[tuple[str, str]]]:
        """(deletions in the order they are made, the other cells)."""
        deletions, rest = [], []
        for c in range(n):
            lead = _step(f"d{c - 1}", str(p.deletion), 0, "-", "'-'")
            match = [] if first or not c else [_plus(f"k{c}", p.mm), f"j{c}"]
            delete = [] if first or not c else [_plus(f"k{c}", p.md)]
            before = c > 0 and (c > 1 or p.enter_delete(0) is not None) and (not first or p.enter_delete(0) is not None)
            match += [lead] if before else []
            delete += [lead] if before else []
            if p.enter_match(c) is not None:
                match.append(_entry(p.enter_match(c), row, c))
            if p.enter_delete(c) is not None:
                delete.append(_entry(p.enter_delete(c), row, c))
            if delete:
                deletions.append(f"{_best(delete)} AS d{c}")
            rest.append((f"m{c}", _best(match) if match else no))
            if c:
                rest.append((f"i{c}", no if first else _best([_plus(f"k{c}", p.mi), f"j{c}"])))
        return deletions, rest

    def nest(base: str, deletions: list[str]) -> str:
        for d in deletions:
            base = f"SELECT *, {d} FROM ({base})"
        return base

    came = []
    for c in range(1, n + 1):
        came.append(_step(f"m{c - 1}", p.letter.format(c=p.word[c - 1], x="x"), 1, "M", "x") + f" AS k{c}")
        if c < n:
            came.append(_step(f"i{c}", str(p.insertion), 2, "I", "lower(x)") + f" AS j{c}")
    out = []
    for c in range(1, n + 1):
        steps = [_plus(f"k{c}", p.leave_match(c))] if p.leave_match(c) is not None else []
        if p.leave_delete(c) is not None:
            steps.append(_plus(_step(f"d{c - 1}", str(p.deletion), 0, "-", "'-'"), p.leave_delete(c)))
        if steps:
            out.append(f"struct_pack(s := ({_best(steps)}).s, c := {c}, p := {_best(steps)})")
    first_d, first = cells("0", True)
    next_d, after = cells("i", False)
    names = ", ".join(f"{x} AS {name}" for name, x in first)
    values = ", ".join(f"{x} AS {name}" for name, x in after)
    none = f"struct_pack(s := -9999, c := 0, p := {no})"
    old = nest(f"SELECT {key}, raw FROM ({source})", first_d)
    came_row = f"SELECT {key}, raw, i, x, {', '.join(came)} FROM (SELECT *, substr(raw, i, 1) AS x FROM (SELECT * REPLACE (i + 1 AS i) FROM r) WHERE i <= length(raw))"
    return f"""
WITH RECURSIVE r AS (
  SELECT {key}, raw, 0 AS i, {names}, {none} AS o FROM ({old})
  UNION ALL
  SELECT {key}, raw, i, {values}, {_best(out)} AS o FROM ({nest(came_row, next_d)}))
SELECT {key}, raw, i AS "row", o.s AS score, o.c AS col, o.p.b AS "begin", o.p.e AS entry, o.p.st || 'X' AS states, o.p.al AS aligned FROM r WHERE i > 0"""


def hits(ends_sql: str, key: str, bound: int, keep: str = "true") -> str:
    """SQL of the alignments that do not overlap, best first, the later row on a tie; keep: which of them count."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n)::INTEGER AS "rank" FROM (
  WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, "row" DESC) AS n FROM ({ends_sql}) WHERE score >= {bound}),
  g AS (
    SELECT {key}, 0::BIGINT AS n, [struct_pack(b := -1, e := -1)] AS used, false AS hit FROM (SELECT DISTINCT {key} FROM c)
    UNION ALL
    SELECT {key}, n, CASE WHEN free THEN list_append(used, struct_pack(b := "begin", e := "row")) ELSE used END,
      free AND len(list_filter(used, lambda u: u.b <= "row" AND u.e >= "begin")) = 0
    FROM (SELECT c.*, g.used, len(list_filter(g.used, lambda u: u.b <= c."row" AND u.e >= c."row")) = 0 AS free FROM g JOIN c ON c.{key} = g.{key} AND c.n = g.n + 1))
  SELECT c.* FROM c JOIN g USING ({key}, n) WHERE g.hit AND ({keep}))"""


def best_by_reduction(source: str, key: str, word: str, text: str = "raw") -> str:
    """SQL of key, score: the best local score of a word (3, -1, gaps -3), folded over the letters of long texts."""
    n = len(word)
    names = [f"{s}{c}" for c in range(1, n) for s in "mi"]
    k = [f"({f'a.m{c - 1}' if c > 1 else '0'} + x.v{c})" for c in range(1, n + 1)]
    d = [k[0]]
    for c in range(2, n):
        d.append(f"greatest({k[c - 1]}, {d[-1]} - 3)")
    fields = [f"'v{c}': 0" for c in range(1, n + 1)]
    for c in range(1, n):
        lead = f", {d[c - 2]} - 3" if c > 1 else ""
        fields += [f"'m{c}': greatest({k[c - 1]}, a.i{c} - 3{lead}, 0)", f"'i{c}': greatest({k[c - 1]}, a.i{c} - 3)"]
    fold = "{" + ", ".join([*fields, f"'best': greatest(a.best, {', '.join(k)})"]) + "}"
    zeros = ", ".join(f"'{x}': {0 if x[0] == 'm' else -9999}" for x in names)
    start = "{" + ", ".join(f"'v{c}': 0" for c in range(1, n + 1)) + f", {zeros}, 'best': -16383}}"
    element = "{" + ", ".join(f"'v{i}': CASE l WHEN '{c}' THEN 3 ELSE -1 END" for i, c in enumerate(word, 1)) + f", {zeros}, 'best': 0}}"
    return f"SELECT {key}, list_reduce(list_transform(regexp_extract_all({text}, '[A-Z]'), lambda l: {element}), lambda a, x: {fold}, {start}).best AS score FROM ({source})"


def heuristic_by_reduction(source: str, key: str, word: str, text: str = "raw") -> str:
    """SQL of key, heuristic: the ungapped score of a word, whose inner letters may be passed by at no cost."""
    n = len(word)
    score = [f"CASE l WHEN '{c}' THEN 3 ELSE {0 if 0 < i < n - 1 else -1} END" for i, c in enumerate(word)]
    zero = ", ".join(f"'{x}{c}': {-9999 if x == 'b' else 0}" for x in "tvb" for c in range(n)) + ", 'n': 0"
    element = "{" + ", ".join(f"'t{c}': {s}" for c, s in enumerate(score)) + ", " + zero.split(f"'t{n - 1}': 0, ")[1] + "}"
    v = [f"(CASE WHEN a.n = 0 THEN x.t{c} ELSE greatest({f'a.v{c - 1} + ' if c else ''}x.t{c}, 0) END)" for c in range(n)]
    parts = [f"'t{c}': 0" for c in range(n)] + [f"'v{c}': {v[c]}" for c in range(n)] + [f"'b{c}': greatest(a.b{c}, {v[c]})" for c in range(n)]
    fold = "{" + ", ".join([*parts, "'n': 1"]) + "}"
    total = " + ".join(f"o.b{c}" for c in range(n))
    return f"""
SELECT {key}, CASE WHEN o.n = 0 THEN 0 ELSE {total} END::INTEGER AS heuristic
FROM (SELECT {key}, list_reduce(list_transform(regexp_extract_all({text}, '[A-Z]'), lambda l: {element}), lambda a, x: {fold}, {{{zero}}}) AS o FROM ({source}))"""


def matrix(source: str, key: str, word: str) -> str:
    """SQL of key, seq, prf, match, insertion, deletion: all cells of a word's profile (3, -1, gaps -3), row 0 included."""
    n = len(word)
    cols = range(n + 1)
    low, no = -12285, -16383  # a step that the boundaries forbid, and one that the transitions forbid
    enter = [0] * n + [low]
    first = ", ".join(f"{enter[c]} AS m{c}, {low} AS i{c}, {low} AS d{c}" for c in cols)
    came = ", ".join([f"m{c - 1} + CASE substr(raw, i, 1) WHEN '{word[c - 1]}' THEN 3 ELSE -1 END AS k{c}" for c in cols if c] + [f"i{c} - 3 AS j{c}" for c in cols])
    now = f"SELECT {key}, raw, i, {came} FROM (SELECT * REPLACE (i + 1 AS i) FROM r) WHERE i <= length(raw)"
    for c in cols:
        options = [f"j{c} + {no}", str(low)] + ([f"k{c}", f"d{c - 1} - 3"] if c else [])
        now = f"SELECT *, greatest({', '.join(options)}) AS d{c} FROM ({now})"
    after = []
    for c in cols:
        more = f"k{c}, d{c - 1} - 3, " if c else ""
        only = f"k{c}, d{c - 1} - 3 + {no}, " if c else ""
        after.append(f"greatest({more}j{c}, {enter[c]}) AS m{c}, greatest({only}j{c}, {low}) AS i{c}, d{c}")
    flat = " UNION ALL ".join(f"SELECT {key}, i AS seq, {c} AS prf, m{c} AS match, i{c} AS insertion, d{c} AS deletion FROM r" for c in cols)
    return f"""
WITH RECURSIVE r AS (SELECT {key}, raw, 0 AS i, {first} FROM ({source}) UNION ALL SELECT {key}, raw, i, {', '.join(after)} FROM ({now}))
{flat}"""


def circular_ends(source: str, key: str, word: str, match: int, mismatch: int, gap: int) -> str:
    """SQL of `ends` and cycles for a circular word of two letters, whose last column leads back to its first.

    On the way back the path goes on from the last column's cell of the state that was met there; an insertion has no
    letter of its own among the states then.
    """
    fields = ("s", "r", "b", "e", "st", "al", "cy")

    def cell(**values: str) -> str:
        return "{" + ", ".join(f"'{f}': {values[f]}" for f in fields) + "}"

    def step(old: str, score: str, rank: int, state: str, aligned: str) -> str:
        return cell(s=f"{old}.s + ({score})", r=str(rank), b=f"{old}.b", e=f"{old}.e", st=f"{old}.st || '{state}'", al=f"{old}.al || {aligned}", cy=f"{old}.cy")

    def entry(row: str, col: int) -> str:
        return cell(s="0", r="3", b=row, e=str(col), st="'X'", al="''", cy="1")

    def back(score: str, path: str, rank: str, aligned: str = "''") -> str:
        return cell(s=score, r=rank, b=f"{path}.b", e=f"{path}.e", st=f"{path}.st || 'R'", al=f"{path}.al || {aligned}", cy=f"{path}.cy + 1")

    def over(state: str, plain: str, by_match: str) -> str:
        """The first column's cell: what it has, or the last column's; the later rank on a tie."""
        led = f"CASE {state}2.r WHEN 2 THEN {back(f'{state}2.s', 'i2', '2', 'lower(x)')} WHEN 1 THEN {back(f'{state}2.s', by_match, '1')} ELSE {back(f'{state}2.s', 'd2', '0')} END"
        return f"CASE WHEN {state}2.s > ({plain}).s OR {state}2.s = ({plain}).s AND {state}2.r >= ({plain}).r THEN {led} ELSE {plain} END"

    no = cell(s="-9999", r="2", b="0", e="0", st="''", al="''", cy="1")
    letter = [f"CASE x WHEN '{c}' THEN {match} ELSE {mismatch} END" for c in word]
    came = [step("m0", letter[0], 1, "M", "x") + " AS k1", step("m1", letter[1], 1, "M", "x") + " AS k2"]
    came += [step(f"i{c}", str(gap), 2, "I", "lower(x)") + f" AS j{c}" for c in range(3)]
    row = f"SELECT *, {', '.join(came)} FROM (SELECT *, substr(raw, i, 1) AS x FROM (SELECT * REPLACE (i + 1 AS i) FROM r) WHERE i <= length(raw))"
    row = f"SELECT *, {step('k1', str(gap), 0, 'D', GAP)} AS l2 FROM ({row})"
    row = f"SELECT *, greatest(k2, l2) AS d2, greatest(k2, j2, l2) AS n2, greatest(k2, j2) AS o2 FROM ({row})"
    row = f"SELECT *, CASE d2.r WHEN 1 THEN {back('d2.s', 'n2', '1')} ELSE {back('d2.s', 'd2', '0')} END AS d0 FROM ({row})"
    new = [
        f"{over('n', 'greatest(j0, ' + entry('i', 0) + ')', 'n2')} AS m0",
        f"greatest(k1, j1, {step('d0', str(gap), 0, 'D', GAP)}, {entry('i', 1)}) AS m1",
        f"{over('o', 'j0', 'n2')} AS i0",
        "greatest(k1, j1) AS i1",
        "o2 AS i2",
        "CASE WHEN k2.s >= k1.s THEN struct_pack(s := k2.s, c := 2, p := k2) ELSE struct_pack(s := k1.s, c := 1, p := k1) END AS o",
    ]
    return f"""
WITH RECURSIVE r AS (
  SELECT {key}, raw, 0 AS i, {entry('0', 0)} AS m0, {entry('0', 1)} AS m1, {no} AS i0, {no} AS i1, {no} AS i2, struct_pack(s := -9999, c := 0, p := {no}) AS o FROM ({source})
  UNION ALL
  SELECT {key}, raw, i, {', '.join(new)} FROM ({row}))
SELECT {key}, raw, i AS "row", o.s AS score, o.c AS col, o.p.b AS "begin", o.p.e AS entry, o.p.st || 'X' AS states, o.p.al AS aligned, o.p.cy AS cycles FROM r WHERE i > 0"""
