"""Long sequences as stretches that advance side by side: scores, begins and paths in memory far below that of cells.

A row of cells is a (max,+) function of the row before: every cell is a maximum of earlier cells plus constants, or an
entry. So a stretch can start before its neighbour is done. Each first runs from no alignment at all; then it runs again
from the last row of the stretch before it, until its rows are those it had, which takes a few residues unless an
alignment is carried far. Cells from which no end that matters can be reached count as equal. Where
stretches stay open, they become (max,+) matrices over match and insertion states, one lane for each state of the row
before, which give every stretch's first row in one product each. All of it is exact.

Ends: the best end of every row, with the row and column where its alignment began. Begins are carried beside the cells
along the moves; what leads out of the stretch is named by the cell of the row before, and names are looked up stretch
by stretch at last. Paths: moves are made again, from a stretch's first row, only where a taken alignment lies. The rows
between stretches are kept, so memory grows with the square root of a long sequence, and a number of ends per residue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np

from ..sources.profiles import NLOW, D, I, M, X

if TYPE_CHECKING:
    from .kernels import Alignment, Kernel

NO = np.int64(-(1 << 40))
STRETCH, LANES, CELLS = 512, 1 << 13, 1 << 20
OPEN_ROUNDS, MATRIX_BYTES = 2, 1 << 26
BAD = np.int64(-(1 << 62))


@dataclass
class Place:
    """An alignment's ends and what its walk back meets: entry row, column and state, and cycles."""

    score: int
    row: int
    col: int
    begin: int
    entry: int
    state: int
    cycles: int

    def alignment(self, kernel: Kernel, states: str, aligned: str) -> Alignment:
        from .kernels import Alignment

        prf = self.entry - 1 if self.state == I else self.entry
        return Alignment(self.score, self.cycles, self.begin, self.row, self.entry, self.col, self.begin, self.row - 1, prf, self.col - 1, max(self.entry - 1, 1), self.col - kernel.length - 1, states, aligned)


@dataclass
class Ends:
    """The best end of each row of a sequence."""

    sequence: int
    score: np.ndarray
    col: np.ndarray
    place: np.ndarray  # (entry row * columns + entry column) * 4 + state
    cycles: np.ndarray
    columns: int

    def pick(self, bound: int, limit: int | None, keep, first: bool) -> list[Place]:
        """Best first; see Kernel.many_hits."""
        n = len(self.score)
        used = np.zeros(n + 1, bool)
        fit = np.flatnonzero((self.score > NLOW) & (self.score >= bound))
        order = fit[np.lexsort((fit if first else -fit, -self.score[fit]))]
        out: list[Place] = []
        for at in order.tolist():
            row = at + 1
            if used[row]:
                continue
            if self.place[at] < 0:
                raise ValueError("an alignment has no entry")
            rest, state = divmod(int(self.place[at]), 4)
            begin, entry = divmod(rest, self.columns)
            overlap = used[begin : row + 1].any()
            used[begin : row + 1] = True
            if overlap:
                continue
            found = Place(int(self.score[at]), row, int(self.col[at]) + 1, begin, entry, state, int(self.cycles[at]))
            if keep is None or keep(_Kept(found), n):
                out.append(found)
                if limit and len(out) >= limit:
                    break
        return out


class _Kept:
    """What a test of an alignment may look at before its path is known."""

    def __init__(self, p: Place):
        self.score, self.cycles, self.seq_begin, self.seq_end = p.score, p.cycles, p.begin, p.row - 1
        self.row_begin, self.row_end, self.col_begin, self.col_end = p.begin, p.row, p.entry, p.col


class Stretches:
    """Sequences cut into stretches of nearly equal length, and the rows between them once `best` has run."""

    def __init__(self, kernel: Kernel, sequences: list[np.ndarray], stretch: int | None = None, starts: np.ndarray | None = None, whole: np.ndarray | None = None):
        """starts: the (match, insertion) rows before each sequence, by default the first rows of the kernel; whole: which
        end where they end, by default all."""
        self.kernel, self.sequences, self.starts = kernel, sequences, starts
        size = np.array([len(s) for s in sequences], np.int64)
        want = np.maximum(stretch or max(STRETCH, 8 * kernel.length), 0 if stretch else np.sqrt(size).astype(np.int64))
        count = -(-size // want)
        self.owner = np.repeat(np.arange(len(size)), count)
        self.head = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        number = np.arange(len(self.owner)) - self.head[self.owner]
        total, of = size[self.owner], count[self.owner]
        self.begin, self.end = number * total // of, (number + 1) * total // of
        self.size = self.end - self.begin
        self.first, self.last = number == 0, (number == of - 1) & (True if whole is None else whole[self.owner])
        self.out_m = self.out_i = None  # the rows after each stretch

    def _before(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows before stretches, as the stretches before them left them."""
        before = np.maximum(pieces - 1, 0)
        m, i = self.out_m[before], self.out_i[before]
        self._head(pieces, m, i)
        return m, i

    def _head(self, pieces: np.ndarray, m: np.ndarray, i: np.ndarray) -> None:
        """Put the rows before sequences in place."""
        head = np.flatnonzero(self.first[pieces])
        if len(head) and self.starts is not None:
            m[head], i[head] = self.starts[self.owner[pieces[head]]].transpose(1, 0, 2)
        elif len(head):
            start = self.kernel.start(1)
            m[head], i[head] = start[M][0], start[I][0]

    def _fresh(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No alignment; before a sequence's first residue, its own first row."""
        m = np.full((len(pieces), self.kernel.length + 1), NO)
        i = m.copy()
        self._head(pieces, m, i)
        return m, i

    def _groups(self, pieces: np.ndarray, cells: int = LANES, each: int = 1) -> Iterator[np.ndarray]:
        """Stretches, longest first, in groups of lanes; each: cells that a lane holds, as a multiple of a row."""
        pieces = pieces[np.argsort(-self.size[pieces], kind="stable")]
        step = max(1, cells // ((self.kernel.length + 1) * each))
        for at in range(0, len(pieces), step):
            yield pieces[at : at + step]

    def _padded(self, pieces: np.ndarray) -> np.ndarray:
        """The residues of stretches side by side, a row for each position."""
        out = np.zeros((int(self.size[pieces].max(initial=0)), len(pieces)), np.uint8)
        for lane, p in enumerate(pieces.tolist()):
            out[: self.size[p], lane] = self.sequences[self.owner[p]][self.begin[p] : self.end[p]]
        return out

    def _steps(self, pieces: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(position, lanes that have it, lanes at their end there, lanes at their sequence's end) of sorted stretches."""
        size, last = self.size[pieces], self.last[pieces]
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 2), "right")
        for at in range(int(size[0])):
            over = np.arange(live[at + 1], live[at])
            yield at, int(live[at]), over, over[last[over]]

    def best(self, bound: int | None = None, top: bool = False) -> np.ndarray:
        """The best score of each sequence, NLOW for an empty one.

        The rows between stretches are then right for what may follow: for all ends that reach bound (top: the best
        score), else for none.
        """
        k, n = self.kernel, len(self.owner)
        self.out_m, self.out_i = (np.full((n, k.length + 1), NO) for _ in range(2))
        best = np.full(n, NLOW, np.int64)
        for lanes in self._groups(np.arange(n)):
            self._run(k, lanes, *self._fresh(lanes), best)
        self._join(best, (lambda: self._by_sequence(best)) if bound is None else (lambda: self._by_sequence(best) - 1) if top else lambda: np.full(len(self.sequences), bound - 1))
        return self._by_sequence(best)

    def _by_sequence(self, best: np.ndarray) -> np.ndarray:
        out = np.full(len(self.sequences), NLOW, np.int64)
        np.maximum.at(out, self.owner, best)
        return out

    def after(self) -> np.ndarray:
        """The (match, insertion) rows after each sequence, once `best` has run; after an empty one, none."""
        out = np.full((len(self.sequences), 2, self.kernel.length + 1), NO)
        some = np.flatnonzero(np.diff(self.head))
        out[some, 0], out[some, 1] = self.out_m[self.head[1:][some] - 1], self.out_i[self.head[1:][some] - 1]
        return out

    def _run(self, kernel: Kernel, lanes: np.ndarray, m: np.ndarray, i: np.ndarray, best: np.ndarray | None) -> None:
        """Advance lanes to their ends, keep their last rows and their best scores."""
        padded = self._padded(lanes)
        top = np.full(len(lanes), NLOW, np.int64)
        for at, live, over, ended in self._steps(lanes):
            m, i, end = kernel.advance(m[:live], i[:live], padded[at, :live], ended)
            np.maximum(top[:live], end.max(axis=1), out=top[:live])
            self.out_m[lanes[over]], self.out_i[lanes[over]] = m[over], i[over]
        if best is not None:
            best[lanes] = np.maximum(best[lanes], top)

    def _join(self, best: np.ndarray, floors) -> None:
        """Run the later stretches again from the rows before them, until nothing changes that may reach above the floors."""
        pending, rounds = np.flatnonzero(~self.first), 0
        gain = self.kernel.gain() if len(pending) else None
        while len(pending):
            if rounds == OPEN_ROUNDS:
                return self._by_matrices(pending, best)
            floor = floors()
            changed = [p for lanes in self._groups(pending, LANES // 2) for p in self._again(lanes, best, floor, gain)]
            later = np.array(sorted(changed), np.int64) + 1
            later = later[later < len(self.owner)]
            pending, rounds = later[~self.first[later]], rounds + 1

    def _again(self, lanes: np.ndarray, best: np.ndarray, floor: np.ndarray, gain: tuple | None) -> list[int]:
        """Run lanes from the rows before them beside a run from none; the stretches whose last row changed."""
        k, padded, n = self.kernel, self._padded(lanes), len(lanes)
        m, i = (np.concatenate(x) for x in zip(self._before(lanes), self._fresh(lanes), strict=True))
        own = np.arange(n)  # lanes that still differ
        least, size, last, changed = floor[self.owner[lanes]], self.size[lanes], self.last[lanes], []

        def same() -> np.ndarray:
            a, b, c, d = m[: len(own)], m[len(own) :], i[: len(own)], i[len(own) :]
            no_m, no_i = a == b, c == d
            if gain is not None:
                bar = least[own][:, None]
                no_m |= a + gain[0] <= bar
                no_i |= c + gain[1] <= bar
            return no_m.all(axis=1) & no_i.all(axis=1)

        for at in range(len(padded)):
            ended = np.flatnonzero((size[own] == at + 1) & last[own])
            m, i, end = k.advance(m, i, np.tile(padded[at, own], 2), np.concatenate([ended, ended + len(own)]))
            np.maximum.at(best, lanes[own], end[: len(own)].max(axis=1))
            over = size[own] == at + 1
            if at % 4 == 3 or over.any():
                equal = same()
                for p in np.flatnonzero(over & ~equal).tolist():
                    piece = int(lanes[own[p]])
                    if (self.out_m[piece] != m[p]).any() or (self.out_i[piece] != i[p]).any():
                        self.out_m[piece], self.out_i[piece] = m[p], i[p]
                        changed.append(piece)
                stay = ~(equal | over)
                if not stay.all():
                    both = np.tile(stay, 2)
                    own, m, i = own[stay], m[both], i[both]
                    if not len(own):
                        break
        return changed

    def _by_matrices(self, pending: np.ndarray, best: np.ndarray) -> None:
        """The rows of the sequences with open stretches by (max,+) products, and their scores from those rows."""
        k, wide = self.kernel, 2 * (self.kernel.length + 1)
        silent = k.silent()
        open_ = np.isin(self.owner, self.owner[pending]) & ~self.first
        pieces = np.flatnonzero(open_)
        step = max(1, MATRIX_BYTES // (8 * wide * wide))
        basis = np.full((wide, wide), NO)
        np.fill_diagonal(basis, 0)
        for lanes in self._groups(pieces):  # rows of a run from none, again, as some were replaced
            self._run(k, lanes, *self._fresh(lanes), None)
        for at in range(0, len(pieces), step):
            own = pieces[at : at + step]
            table = np.empty((len(own), wide, wide), np.int64)
            for group in self._groups(own, LANES, wide):
                lanes = np.repeat(group, wide)
                m, i = (np.tile(basis[:, h], (len(group), 1)) for h in (slice(0, k.length + 1), slice(k.length + 1, wide)))
                padded = np.repeat(self._padded(group), wide, axis=1)
                size = self.size[lanes]
                place = np.searchsorted(own, group)
                for pos in range(len(padded)):
                    live = int(np.searchsorted(-size, -(pos + 1), "right"))
                    m, i, _ = silent.advance(m[:live], i[:live], padded[pos, :live], np.zeros(0, np.int64))
                    for g in np.flatnonzero(self.size[group] == pos + 1).tolist():
                        table[place[g]] = np.concatenate([m[g * wide : (g + 1) * wide], i[g * wide : (g + 1) * wide]], axis=1)
            for j, piece in enumerate(own.tolist()):
                m, i = self._before(np.array([piece]))
                carried = (np.concatenate([m[0], i[0]])[:, None] + table[j]).max(axis=0)
                self.out_m[piece] = np.maximum(self.out_m[piece], carried[: k.length + 1])
                self.out_i[piece] = np.maximum(self.out_i[piece], carried[k.length + 1 :])
        for lanes in self._groups(pieces):
            self._run(k, lanes, *self._before(lanes), best)

    def _moves(self, lanes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, dict, np.ndarray, np.ndarray]]:
        """(position, live lanes, lanes at their end, cells, moves, wraps) of each row of sorted stretches."""
        k, padded = self.kernel, self._padded(lanes)
        m, i = self._before(lanes)
        now = {M: m, I: i}
        for at, live, over, ended in self._steps(lanes):
            last = np.zeros(live, bool)
            last[ended] = True
            now, how = k.row({t: now[t][:live] for t in (M, I)}, padded[at, :live], last)
            yield at, live, over, now, *k.moves(now, how)

    def _carry(self, place: np.ndarray, cycles: np.ndarray, moves: np.ndarray, wraps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the alignments of each cell (lane, column, state) of a row began, from the row before and the moves."""
        k = self.kernel
        lanes, columns = moves.shape[:2]
        diagonal = np.concatenate([np.full((lanes, 1), BAD), place[:, :-1, M]], axis=1)
        inserted, turns = place[:, :, I], cycles[:, :, I]
        if k.model == "extended":
            inserted = np.concatenate([place[:, :1, I], place[:, :-1, I]], axis=1)
            turns = np.concatenate([cycles[:, :1, I], cycles[:, :-1, I]], axis=1)
        here = ((row[:, None] * columns + np.arange(columns)) * 4)[:, :, None] + np.arange(4)
        new = np.where(moves == X, here, np.where(moves == M, diagonal[:, :, None], inserted[:, :, None]))
        if k.model != "circular":
            column = np.where(moves[:, :, D] == D, 0, np.arange(columns))
            source = np.maximum.accumulate(column, axis=1)
            deleted = np.take_along_axis(new[:, :, D], source, axis=1)
            deleted[np.take_along_axis(moves[:, :, D], source, axis=1) == D] = BAD  # a deletion before the first column
            left = np.concatenate([np.full((lanes, 1), BAD), deleted[:, :-1]], axis=1)
            return np.where(moves == D, left[:, :, None], new), cycles
        count = np.where(moves == X, 1, np.where(moves == M, np.concatenate([np.ones((lanes, 1), np.int64), cycles[:, :-1, M]], axis=1)[:, :, None], turns[:, :, None]))
        node = np.broadcast_to(np.arange(columns * 4).reshape(columns, 4), moves.shape)
        left = (np.arange(columns)[:, None] - 1) * 4 + D
        to = np.where(moves == D, left, node)
        extra = np.zeros(moves.shape, np.int64)
        over, state = np.nonzero(wraps)
        if len(over):
            move = moves[over, 0, state]
            by_insertion, inside = move == I, (move == M) | (move == D)
            new[over[by_insertion], 0, state[by_insertion]] = place[over[by_insertion], -1, I]
            count[over[by_insertion], 0, state[by_insertion]] = cycles[over[by_insertion], -1, I] + k.insertion_wraps
            to[over[inside], 0, state[inside]] = (columns - 1) * 4 + move[inside]
            extra[over[inside], 0, state[inside]] = 1
        bad = to < 0
        new[bad], to = BAD, np.where(bad, node, to)
        flat = lambda x: x.reshape(lanes, -1)
        to, extra, new, count = flat(to), flat(extra), flat(new), flat(count)
        for _ in range(int(4 * columns).bit_length() + 1):
            after = np.take_along_axis(to, to, axis=1)
            if (after == to).all():
                break
            extra = extra + np.take_along_axis(extra, to, axis=1)
            to = after
        ring = np.take_along_axis(to, to, axis=1) != to
        new = np.where(ring, BAD, np.take_along_axis(new, to, axis=1))
        count = np.take_along_axis(count, to, axis=1) + extra
        return new.reshape(moves.shape), count.reshape(moves.shape)

    def _first_places(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the row before each stretch: names of its cells, or where the first row's own alignments began."""
        k, columns = self.kernel, self.kernel.length + 1
        place = np.broadcast_to(-1 - np.arange(columns * 4, dtype=np.int64).reshape(1, columns, 4), (len(lanes), columns, 4)).copy()
        cycles = np.zeros(place.shape, np.int64)
        head = np.flatnonzero(self.first[lanes])
        if len(head):
            moves, wraps = k.moves(k.start(1), None)
            own, turns = self._carry(np.full((1, columns, 4), BAD), np.ones((1, columns, 4), np.int64), moves, wraps, np.zeros(1, np.int64))
            place[head], cycles[head] = own, turns
        return place, cycles

    def ends(self, some: list[int]) -> Iterator[list[Ends]]:
        """The best end of each row of some sequences, a group of them at once; ties of a row go to the last column."""
        k, columns = self.kernel, self.kernel.length + 1
        circular = k.model == "circular"
        for group in self._together(some):
            pieces = np.concatenate([np.arange(self.head[s], self.head[s + 1]) for s in group])
            start = np.concatenate([[0], np.cumsum(self.size[pieces])])
            score, col, place, turns = (np.zeros(int(start[-1]), np.int64) for _ in range(4))
            after, after_turns = (np.zeros((len(pieces), columns, 4), np.int64) for _ in range(2))
            for lanes in self._groups(pieces):
                at_piece = np.searchsorted(pieces, lanes)
                own, count = self._first_places(lanes)
                for at, live, over, cells, moves, wraps in self._moves(lanes):
                    own, count = self._carry(own[:live], count[:live], moves, wraps, self.begin[lanes[:live]] + at + 1)
                    end = cells[X][:, 1:]
                    best = k.length - 1 - np.argmax(end[:, ::-1], axis=1)
                    lane, to = np.arange(live), start[at_piece[:live]] + at
                    score[to], col[to] = end[lane, best], best
                    place[to], turns[to] = own[lane, best + 1, X], count[lane, best + 1, X]
                    after[at_piece[over]], after_turns[at_piece[over]] = own[over], count[over]
            for j, p in enumerate(pieces.tolist()):  # names of cells of the stretch before
                if self.first[p]:
                    continue
                before, before_turns = after[j - 1].ravel(), after_turns[j - 1].ravel()
                for what, n in ((after[j].ravel(), after_turns[j].ravel()), (place[start[j] : start[j + 1]], turns[start[j] : start[j + 1]])):
                    named = np.flatnonzero((what < 0) & (what > BAD))
                    name = -1 - what[named]
                    what[named], n[named] = before[name], n[named] + before_turns[name]
            at, out = 0, []
            for s in group:
                a, b = int(start[at]), int(start[at + self.head[s + 1] - self.head[s]])
                out.append(Ends(s, score[a:b], col[a:b], place[a:b], turns[a:b] if circular else np.zeros(b - a, np.int64), columns))
                at += int(self.head[s + 1] - self.head[s])
            yield out

    def _together(self, some: list[int]) -> Iterator[list[int]]:
        """Sequences in order, in groups of about CELLS residues."""
        group, n = [], 0
        for s in some:
            group.append(s)
            n += len(self.sequences[s])
            if n >= CELLS:
                yield group
                group, n = [], 0
        if group:
            yield group

    def paths(self, picked: dict[int, list[Place]], texts: list[str]) -> dict[int, list[tuple[str, str]]]:
        """(states, aligned text) of the alignments taken in each sequence, which do not overlap."""
        walks = {s: [Walk(self.kernel, p) for p in own] for s, own in picked.items()}
        need = np.zeros(len(self.owner) + 1, np.int64)  # stretches that an alignment touches
        ends: dict[int, list[Walk]] = {}
        for s, own in walks.items():
            low, edge = int(self.head[s]), self.end[self.head[s] : self.head[s + 1]]
            for p, walk in zip(picked[s], own, strict=True):
                last = low + int(np.searchsorted(edge, p.row))
                need[low + np.searchsorted(edge, max(p.begin, 1))] += 1
                need[last + 1] -= 1
                ends.setdefault(last, []).append(walk)
        pieces = np.flatnonzero(np.cumsum(need)[:-1])
        opened: list[Walk] = []
        for own in self._back(pieces):
            lanes = own[np.argsort(-self.size[own], kind="stable")]
            moves = np.zeros((len(lanes), int(self.size[lanes[0]]) + 1, self.kernel.length + 1, 4), np.int8)
            wraps = np.zeros((len(lanes), moves.shape[1], 4), bool)
            for pos, live, _, _, m, w in self._moves(lanes):
                moves[:live, pos + 1], wraps[:live, pos + 1] = m, w
            head = np.flatnonzero(self.first[lanes])
            if len(head):
                moves[head, 0], wraps[head, 0] = self.kernel.moves(self.kernel.start(1), None)
            for lane in np.argsort(-lanes).tolist():
                piece = int(lanes[lane])
                opened = [w for w in opened if not w.over] + ends.get(piece, [])
                for walk in opened:
                    walk.go(moves[lane], wraps[lane], int(self.begin[piece]), texts[self.owner[piece]])
        return {s: [walk.text() for walk in own] for s, own in walks.items()}

    def _back(self, pieces: np.ndarray) -> Iterator[np.ndarray]:
        """Stretches from the last to the first, in groups of about CELLS cells."""
        cells = np.cumsum((self.size[pieces[::-1]] * (self.kernel.length + 1)))
        group = cells // CELLS
        for g in np.unique(group).tolist():
            yield pieces[::-1][group == g]


def settle(kernel: Kernel, sequences: list[np.ndarray], starts: np.ndarray, after: np.ndarray, whole: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best scores, whether the rows after change) of stretches that ran from none, now from the rows before them.

    A stretch is left as soon as its rows are those of the run from none, which had the given scores and rows after.
    """
    own = Stretches(kernel, sequences, max(map(len, sequences), default=1), starts, whole)
    own.out_m, own.out_i = after[:, 0].copy(), after[:, 1].copy()
    found, fresh = best.copy(), Stretches(kernel, sequences, max(map(len, sequences), default=1), np.full_like(starts, NO), whole)
    own._fresh = fresh._fresh
    changed = np.zeros(len(sequences), bool)
    for lanes in own._groups(np.arange(len(sequences)), LANES // 2):
        changed[own._again(lanes, found, best, kernel.gain())] = True
    return found, changed


class Walk:
    """The way back from an end, stretch by stretch."""

    def __init__(self, kernel: Kernel, end: Place):
        self.kernel, self.circular = kernel, kernel.model == "circular"
        self.row, self.col, self.state, self.over = end.row, end.col, X, False
        self.states, self.aligned = ["X"], []
        self.left = 4 * (end.row + 2) * (kernel.length + 2)

    def go(self, moves: np.ndarray, wraps: np.ndarray, base: int, letters: str) -> None:
        """Walk while the row is one of this block: base + 1 on, or row 0 of the sequence."""
        states, aligned, length, extended = self.states, self.aligned, self.kernel.length, self.kernel.model == "extended"
        row, col, state = self.row, self.col, self.state
        while row > base or base == 0:
            if row < 0 or col < 0 or self.left < 0:
                raise ValueError("an alignment has no entry")
            self.left -= 1
            move = int(moves[row - base, col, state])
            if move == X:
                states.append("X")
                self.over = True
                break
            if self.circular and col == 0 and state != X and wraps[row - base, state]:
                states.append("R")
                col = length
                if move == I:
                    row -= 1
                    aligned.append(letters[row].lower())
            elif move == M:
                row, col = row - 1, col - 1
                states.append("M")
                aligned.append(letters[row].upper())
            elif move == I:
                row -= 1
                col -= extended and col > 0
                states.append("I")
                aligned.append(letters[row].lower())
            else:
                col -= 1
                states.append("D" if self.circular else "-")
                aligned.append("-")
            state = move
        self.row, self.col, self.state = row, col, state

    def text(self) -> tuple[str, str]:
        if not self.over:
            raise ValueError("an alignment has no entry")
        return "".join(reversed(self.states)), "".join(reversed(self.aligned))
