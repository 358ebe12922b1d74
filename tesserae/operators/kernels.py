"""Alignment of encoded sequences with a profile, row by row over numpy arrays.

Rows are sequence positions, columns profile positions. Only the deletion chain runs along a row; as a maximum of
sums it is a running maximum after subtracting the running sum of its steps, so a row is a fixed number of array
operations. Many sequences, and stretches of long ones, advance side by side (see stretches); cells are kept only where
they are asked for.

Models: standard; circular (the last column leads back to the first); glocal (entry at the first cell and down the
first column only); extended (insertions also advance a column). Ties: end before insertion before match before
deletion; in the extended model deletion comes before insertion and match.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..sources.profiles import DEL, MLOW, NLOW, D, I, M, Profile, X
from .stretches import NO, Stretches

STANDARD, CIRCULAR, GLOCAL, EXTENDED = "standard", "circular", "glocal", "extended"
MODELS = (STANDARD, CIRCULAR, GLOCAL, EXTENDED)


@dataclass
class Alignment:
    score: int
    cycles: int
    row_begin: int
    row_end: int
    col_begin: int
    col_end: int
    seq_begin: int
    seq_end: int
    prf_begin: int
    prf_end: int
    ipmb: int
    ipme: int
    states: str
    aligned: str


class Kernel:
    """A profile's tables, ready for rows of scores; insertion_wraps: whether cycles count wraps from an insertion."""

    def __init__(self, profile: Profile, model: str | None = None, insertion_wraps: bool = True):
        self.insertion_wraps = insertion_wraps
        self.model = model or (CIRCULAR if profile.circular else STANDARD)
        if self.model not in MODELS:
            raise ValueError(f"model {self.model!r}")
        tables = profile.tables()
        self.length, self.lut = profile.length, profile.lut
        t = tables["transition"]
        self.to = {(a, b): t[:, 4 * a + b] for a in (M, I, D, X) for b in (M, I, D, X)}
        self.first, self.last = tables["first"], tables["last"]
        self.match = profile.match.T.astype(np.int64).copy()  # residue x length
        self.insertion = profile.insertion.T.astype(np.int64).copy()  # residue x (length + 1)
        self.delete = np.concatenate([[0], profile.match[:, DEL]]).astype(np.int64)
        self.chain = np.cumsum(self.delete + np.where(np.arange(self.length + 1) > 0, self.to[D, D], 0))
        states = range(4)
        # of the standard model's score rows: what a residue adds on the way from match or insertion to each state
        self.by_match = np.stack([np.concatenate([np.full((len(self.match), 1), NO), self.match + self.to[M, t][1:]], axis=1) for t in states], axis=1)
        self.by_insertion = np.stack([self.insertion + self.to[I, t] for t in states], axis=1)
        self.by_match_lanes, self.by_insertion_lanes = (np.ascontiguousarray(x.transpose(1, 2, 0)) for x in (self.by_match, self.by_insertion))
        self.by_delete = np.stack([self.delete[1:] + self.to[D, t][1:] for t in states])
        self.enter = np.stack([self.to[X, t] if t != X else np.full(self.length + 1, NLOW) for t in states])
        # in the row of the last residue other steps lead to the end
        self.end_match = np.concatenate([np.full((len(self.match), 1), NO), self.match + self.last[1:, M]], axis=1)
        self.end_insertion, self.end_delete = self.insertion + self.last[:, I], self.delete[1:] + self.last[1:, D]
        self.rank = {D: 0, M: 1, I: 2, X: 3} if self.model != EXTENDED else {M: 0, I: 1, D: 2, X: 3}

    def encode(self, text: str) -> np.ndarray:
        """Alphabet positions of the letters of a text; other characters are dropped."""
        raw = np.frombuffer(text.encode(), np.uint8)
        letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
        return self.lut[raw[letters]]

    def _scan(self, base: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(base - self.chain, axis=-1) + self.chain

    def _wrap(self, cells: dict[int, np.ndarray]) -> None:
        """Lead the last column back to the first, and run the deletions again."""
        for t in (M, I, D):
            cells[t][:, 0] = np.maximum(cells[t][:, 0], cells[t][:, -1])
        again = self._scan(np.concatenate([cells[D][:, :1], np.full((len(cells[D]), self.length), NO)], axis=1))
        before = np.maximum(again, cells[D])
        cells[D] = self._scan(before)
        step = cells[D][:, :-1] + self.delete[1:]
        for t in (M, I):
            cells[t][:, 1:] = np.maximum(cells[t][:, 1:], step + self.to[D, t][1:])

    def start(self, lanes: int) -> dict[int, np.ndarray]:
        """The cells before the first residue."""
        shape = (lanes, self.length + 1)
        if self.model == GLOCAL:
            cells = {t: np.full(shape, NLOW, np.int64) for t in (M, I, D, X)}
            cells[M][:, 0] = self.first[0, M]
            return cells
        cells = {t: np.broadcast_to(self.first[:, t], shape).astype(np.int64) for t in (M, I)}
        cells[D] = self._scan(np.broadcast_to(self.first[:, D], shape))
        step = cells[D][:, :-1] + self.delete[1:]
        for t in (M, I):
            cells[t][:, 1:] = np.maximum(cells[t][:, 1:], step + self.to[D, t][1:])
        cells[X] = np.full(shape, NLOW, np.int64)
        if self.model == CIRCULAR:
            self._wrap(cells)
        return cells

    def row(self, before: dict[int, np.ndarray], residue: np.ndarray, last: np.ndarray, entry: np.ndarray | None = None) -> tuple[dict[int, np.ndarray], dict]:
        """(cells after one more residue in each lane, the candidates they come from); last: lanes at their end."""
        lanes = len(residue)
        none = np.full((lanes, 1), NO)
        ins = self.insertion[residue]
        column0 = before[I][:, :1] + ins[:, :1] if self.model in (STANDARD, CIRCULAR) else np.full((lanes, 1), np.int64(NLOW))
        came = {}
        enter = {t: np.broadcast_to(self.to[X, t], (lanes, self.length + 1)).astype(np.int64) for t in (M, I, D)}
        if self.model == GLOCAL:
            for t in enter:
                enter[t][:, 1:] = NO
        top = before[M][:, :-1]
        if self.model == CIRCULAR:
            now = np.maximum(column0[:, 0] + self.to[I, M][0], enter[M][:, 0])
            top = top.copy()
            top[:, 0] = np.maximum(now, top[:, 0])
        came[M] = np.concatenate([none, top + self.match[residue]], axis=1)
        if self.model == EXTENDED:
            came[I] = np.concatenate([column0, before[I][:, :-1] + ins[:, 1:]], axis=1)
        else:
            came[I] = np.concatenate([column0, before[I][:, 1:] + ins[:, 1:]], axis=1)
        leave = {s: np.where(last[:, None], self.last[:, s], self.to[s, X]) for s in (M, I, D)}
        cells = {}
        base = np.maximum(np.maximum(came[M] + self.to[M, D], came[I] + self.to[I, D]), enter[D])
        cells[D] = self._scan(base)
        came[D] = np.concatenate([none, cells[D][:, :-1] + self.delete[1:]], axis=1)
        for t in (M, I):
            cells[t] = np.maximum(np.maximum(came[M] + self.to[M, t], came[I] + self.to[I, t]), np.maximum(came[D] + self.to[D, t], enter[t]))
        cells[X] = np.maximum(np.maximum(came[M] + leave[M], came[I] + leave[I]), np.maximum(came[D] + leave[D], NLOW))
        plain = {t: c.copy() for t, c in cells.items()} if self.model == CIRCULAR else cells
        if self.model == CIRCULAR:
            self._wrap(cells)
        return cells, {"came": came, "enter": enter, "leave": leave, "plain": plain}

    def _groups(self, sequences: list[np.ndarray], cells: int) -> list[list[int]]:
        """The non-empty sequences, longest first, in groups of lanes; a group has about so many cells, one lane at least."""
        order = [k for k in np.argsort([-len(s) for s in sequences], kind="stable").tolist() if len(sequences[k])]
        out, at = [], 0
        while at < len(order):
            step = max(1, cells // ((self.length + 1) * (len(sequences[order[at]]) + 1)))
            out.append(order[at : at + step])
            at += step
        return out

    @staticmethod
    def _padded(sequences: list[np.ndarray], lanes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(residues of the lanes side by side, a row for each position; lengths)."""
        size = np.array([len(sequences[k]) for k in lanes])
        padded = np.zeros((size[0], len(lanes)), np.uint8)
        for i, k in enumerate(lanes):
            padded[: size[i], i] = sequences[k]
        return padded, size

    def advance(self, m: np.ndarray, i: np.ndarray, residue: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(match, insertion, end scores by column) after one more residue; ended: the lanes that are at their end."""
        if self.model != STANDARD:
            last = np.zeros(len(residue), bool)
            last[ended] = True
            cells, _ = self.row({M: m, I: i}, residue, last)
            return cells[M], cells[I], cells[X][:, 1:]
        # lanes are the last axis of all arrays here, so that every operation runs along them
        m, i = m.T, i.T
        before = np.concatenate([m[:1], m[:-1]])
        cells = before + np.take(self.by_match_lanes, residue, axis=2)
        np.maximum(cells, i + np.take(self.by_insertion_lanes, residue, axis=2), out=cells)
        np.maximum(cells, self.enter[:, :, None], out=cells)
        deletion = self._scan(cells[D].T).T if self.length > 16 else self._scan_lanes(cells[D])
        np.maximum(cells[:, 1:], deletion[:-1] + self.by_delete[:, :, None], out=cells[:, 1:])
        end = cells[X, 1:].T
        if len(ended):
            r = residue[ended]
            own = np.maximum(before[:, ended].T + self.end_match[r], i[:, ended].T + self.end_insertion[r])[:, 1:]
            end[ended] = np.maximum(np.maximum(own, deletion[:-1, ended].T + self.end_delete), NLOW)
        return cells[M].T, cells[I].T, end

    def _scan_lanes(self, base: np.ndarray) -> np.ndarray:
        """As _scan, of columns by lanes."""
        out = base.copy()
        for j, step in enumerate(np.diff(self.chain).tolist(), 1):
            np.maximum(out[j], out[j - 1] + step, out=out[j])
        return out

    def gain(self) -> tuple[np.ndarray, np.ndarray] | None:
        """What an alignment may add at most to a match or an insertion score of a row before it ends; standard model only.

        Columns never fall and only insertions stay in one, so one pass from the last column finds it.
        """
        if self.model != STANDARD:
            return None
        size = self.length + 1
        m, i, d = (np.full(size + 1, NO) for _ in range(3))
        match, insertion = self.by_match.max(axis=0), self.by_insertion.max(axis=0)
        for j in range(self.length, -1, -1):
            if j < self.length:
                onward = (m[j + 1], i[j + 1], np.int64(0))
                d[j] = max(self.delete[j + 1] + self.to[D, D][j + 1] + d[j + 1], self.end_delete[j], *(self.by_delete[t, j] + v for t, v in zip((M, I, X), onward, strict=True)))
                m[j] = max(match[D, j + 1] + d[j + 1], self.end_match[:, j + 1].max(), *(match[t, j + 1] + v for t, v in zip((M, I, X), onward, strict=True)))
            i[j] = max(insertion[M, j] + m[j], insertion[D, j] + d[j], insertion[X, j], self.end_insertion[:, j].max())
            if insertion[I, j] > 0:
                i[j] = -NO  # grows without end
        return m[:-1], i[:-1]

    def silent(self) -> Kernel:
        """The same kernel without any entry: what comes out is carried from the row before."""
        out = copy.copy(self)
        no = np.full(self.length + 1, NO)
        out.to = {k: no if k[0] == X else v for k, v in self.to.items()}
        out.enter = np.full_like(self.enter, NO)
        return out

    def best_scores(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The best score of each sequence; an empty one has NLOW."""
        return Stretches(self, sequences).best()

    def matrix(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, moves, wraps) of every cell: rows x columns x states; a move is the state a cell came from."""
        if len(sequence):
            return next(self.matrices([sequence]))[1:]
        scores, moves, wraps = self._empty(1, 0)
        self._put(scores, moves, wraps, 0, self.start(1), None)
        return scores[0], moves[0], wraps[0]

    def _empty(self, lanes: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (lanes, n + 1, self.length + 1, 4)
        return np.full(shape, NLOW, np.int32), np.full(shape, X, np.int8), np.zeros((lanes, n + 1, 4), bool)

    def matrices(self, sequences: list[np.ndarray], cells: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(position, scores, moves, wraps) of each non-empty sequence, in any order; so many cells are held at once, 20 bytes
        each, or those of one sequence."""
        for lanes in self._groups(sequences, cells):
            padded, size = self._padded(sequences, lanes)
            scores, moves, wraps = self._empty(len(lanes), size[0])
            now = self.start(len(lanes))
            self._put(scores, moves, wraps, 0, now, None)
            for i in range(size[0]):
                live = int(np.searchsorted(-size, -(i + 1), "right"))
                now, how = self.row({t: c[:live] for t, c in now.items()}, padded[i, :live], size[:live] == i + 1)
                self._put(scores, moves, wraps, i + 1, now, how)
            for at, k in enumerate(lanes):
                n = len(sequences[k]) + 1
                yield k, scores[at, :n], moves[at, :n], wraps[at, :n]

    def scored(self, sequences: list[np.ndarray], cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, lengths, scores: lanes x rows x columns x states) of all sequences, longest first in each group; rows behind
        a length are NLOW. So many cells are held at once, 16 bytes each, or those of one sequence."""
        empty = [k for k, s in enumerate(sequences) if not len(s)]
        for lanes in [*self._groups(sequences, cells), *([empty] if empty else [])]:
            padded, size = self._padded(sequences, lanes)
            out = np.full((len(lanes), len(padded) + 1, self.length + 1, 4), NLOW, np.int32)
            now = self.start(len(lanes))
            for i in range(len(padded) + 1):
                if i:
                    live = int(np.searchsorted(-size, -i, "right"))
                    now, _ = self.row({t: c[:live] for t, c in now.items()}, padded[i - 1, :live], size[:live] == i)
                for t in (M, I, D, X):
                    out[: len(now[t]), i, :, t] = np.maximum(now[t], np.iinfo(np.int32).min // 2)
            yield np.array(lanes, np.int64), size, out

    def _put(self, scores: np.ndarray, moves: np.ndarray, wraps: np.ndarray, i: int, cells: dict, how: dict | None) -> None:
        """Keep row i of the lanes that have one, which come first."""
        live = len(cells[M])
        for t in (M, I, D, X):
            scores[:live, i, :, t] = np.maximum(cells[t], np.iinfo(np.int32).min // 2)
        moves[:live, i], wraps[:live, i] = self.moves(cells, how)

    def moves(self, cells: dict[int, np.ndarray], how: dict | None) -> tuple[np.ndarray, np.ndarray]:
        """(moves, wraps) of a row of each lane; how is None for the row before the first residue."""
        order = sorted((M, I, D, X), key=lambda s: self.rank[s])
        live = len(cells[M])
        moves, wraps = np.full((live, self.length + 1, 4), X, np.int8), np.zeros((live, 4), bool)
        none = np.full((live, 1), NO)
        for t in (M, I, D, X):
            value = cells[t]
            by_delete = np.concatenate([none, cells[D][:, :-1] + self.delete[1:] + self.to[D, t][1:]], axis=1) if t != X else none
            if how is None:
                if t != X and self.model != GLOCAL:
                    moves[:, :, t] = np.where((value == by_delete) & (value > self.first[:, t]), D, X)
                    if self.model == CIRCULAR:
                        over = value[:, 0] > self.first[0, t]
                        wraps[:, t] = over
                        moves[:, 0, t] = np.where(over, moves[:, -1, t], moves[:, 0, t])
                continue
            options = {s: how["came"][s] + (how["leave"][s] if t == X else self.to[s, t]) for s in (M, I, D)}
            options[X] = how["enter"][t] if t != X else np.full((live, self.length + 1), NO)
            if self.model == CIRCULAR and t != X:
                options[D] = by_delete
            move = np.full(value.shape, X, np.int8)
            for s in order:  # the last state that reaches the value wins
                move[options[s] == value] = s
            moves[:, :, t] = move
            if self.model == CIRCULAR and t != X:
                plain = how["plain"][t]
                own = np.full(live, X, np.int8)  # what the first column comes from without a wrap
                for s in order:
                    if s != D:
                        own[options[s][:, 0] == plain[:, 0]] = s
                edge = move[:, -1]
                rank = np.array([self.rank[s] for s in range(4)])
                over = (value[:, 0] > plain[:, 0]) | (plain[:, -1] == plain[:, 0]) & (rank[edge] >= rank[own])
                wraps[:, t] = over
                moves[:, 0, t] = np.where(over, edge, own)
        return moves, wraps

    def trace(self, moves: np.ndarray, wraps: np.ndarray, row: int, col: int, letters: str) -> tuple[int, int, int, int, str, str, int]:
        """(row and column of the entry, cycles, last state, states, aligned text, first state) walking back from an end."""
        state, cycles, states, aligned, first = X, 1, ["X"], [], X
        circular = self.model == CIRCULAR
        for _ in range(4 * (row + 2) * (self.length + 2)):
            move = int(moves[row, col, state])
            if move == X:
                states.append("X")
                return row, col, cycles if circular else 0, state, "".join(reversed(states)), "".join(reversed(aligned)), first
            wrapped = circular and col == 0 and state != X and bool(wraps[row, state])
            first = first if first != X else move
            if wrapped:
                cycles += 1
                states.append("R")
                col = self.length
                if move == I:
                    row -= 1
                    aligned.append(letters[row].lower())
            elif move == M:
                row, col = row - 1, col - 1
                states.append("M")
                aligned.append(letters[row].upper())
            elif move == I:
                row -= 1
                col -= self.model == EXTENDED and col > 0
                states.append("I")
                aligned.append(letters[row].lower())
            else:
                col -= 1
                states.append("D" if circular else "-")
                aligned.append("-")
            state = move
            if row < 0 or col < 0:
                break
        raise ValueError("an alignment has no entry")

    def hits(self, letters: str, bound: int, limit: int | None = None, keep=None) -> list[Alignment]:
        """The alignments of one text; see many_hits."""
        return self.many_hits([letters], bound, limit, keep)[0]

    def many_hits(self, texts: list[str], bound: int, limit: int | None = None, keep=None, first: bool = False, paths: bool = True) -> list[list[Alignment]]:
        """Of each text the alignments that do not overlap, best first, until a score falls below bound.

        Ties: the last row (first: the first row), then the last column. keep decides which count toward limit; dropped
        ones still use up their rows, the row of entry included, and an alignment that touches used rows is dropped.
        Scores come first, for all texts side by side; for those that reach the bound, the best end of each row and
        where its alignment begins; and for the alignments taken, the way between (paths: else states and text are
        empty). No pass keeps the cells of a text.
        """
        sequences = [self.encode(t) for t in texts]
        out: list[list[Alignment]] = [[] for _ in texts]
        scored = Stretches(self, sequences)
        best = scored.best(bound, top=limit == 1 and keep is None)
        some = np.flatnonzero((best > NLOW) & (best >= bound)).tolist()
        for group in scored.ends(some):
            picked = {e.sequence: e.pick(bound, limit, keep, first) for e in group}
            ways = scored.paths(picked, texts) if paths else {k: [("", "")] * len(own) for k, own in picked.items()}
            for k, own in picked.items():
                out[k] = [p.alignment(self, *way) for p, way in zip(own, ways[k], strict=True)]
        return out


def tag_profile(tag: str, scores: dict | None = None) -> Profile:
    """The profile that maps a whole tag anywhere in a sequence; an N in the tag matches all, one in the sequence is 0."""
    s = MAP_SCORES if scores is None else scores
    n, letters = len(tag), "ACGTN"
    match = np.zeros((n, 29), np.int64)
    for i, c in enumerate(tag.upper()):
        match[i, 1:5] = [s["Scores"]["Match"] if c in (a, "N") else s["Scores"]["MisMatch"] for a in "ACGT"]
        match[i, 0] = s["Scores"]["MisMatch"]
        match[i, DEL] = s["Scores"]["Deletion"]
    insertion = np.full((n + 1, 29), s["Scores"]["Insertion"], np.int64)
    boundary = np.zeros((n + 1, 11), np.int64)
    names = ["B0", "B1", "E0", "E1", "BM", "BI", "BD", "BE", "ME", "IE", "DE"]
    move = s["Transitions"]
    for name, value in (("BM", s["Begin"]["Match"]), ("BD", s["Begin"]["Deletion"]), ("BI", NLOW), ("ME", move["MM"]), ("IE", NLOW), ("DE", move["DM"])):
        boundary[:, names.index(name)] = value
    transition = np.zeros((n + 1, 16), np.int64)
    for a, x in (("M", M), ("I", I), ("D", D)):
        for b, y in (("M", M), ("I", I), ("D", D)):
            transition[:, 4 * x + y] = max(move[a + b], NLOW)
    return Profile(identification=tag, alphabet=letters, length=n, n1=n, n2=1, cutoff=[{"level": 0, "score": MLOW, "modes": []}], consensus=tag, match=match, insertion=insertion, boundary=boundary, transition=transition)


#: The scores of tag mapping.
MAP_SCORES = {
    "Begin": {"Match": 0, "Deletion": -2},
    "Scores": {"Match": 3, "MisMatch": -1, "Insertion": 0, "Deletion": -1},
    "Transitions": {"MM": 1, "MI": -15, "MD": -3, "IM": 0, "II": 0, "ID": NLOW, "DM": 0, "DI": NLOW, "DD": 0},
}


def heuristic_table(profile: Profile) -> np.ndarray:
    """Match scores (length x alphabet) for the heuristic; inner positions may also pass by a gap."""
    t = profile.tables()["transition"]
    out = profile.match[:, : 1 + len(profile.alphabet)].astype(np.int64).copy()
    for j in range(1, profile.length - 1):
        out[j] = np.maximum(out[j], max(t[j, 4 * M + D] + t[j + 1, 4 * D + M], t[j, 4 * M + I] + t[j + 1, 4 * I + M]))
    return out


def heuristic_score(table: np.ndarray, sequence: np.ndarray) -> int:
    """Sum over positions of the best ungapped run that ends there; runs restart at 0 after the first residue.

    All residues at once, a step for each position of the profile.
    """
    if not len(sequence):
        return 0
    total, run = 0, np.zeros(len(sequence), np.int64)
    for scores in table:
        own = scores[sequence]
        own[1:] = np.maximum(own[1:] + run[:-1], 0)
        run = own
        total += int(run.max())
    return total
