"""Token ids of whole texts by a public tokenizer file.

Tokenizers of the word-level kind drop white space, so a text's ids are those of its runs of non-space bytes one after
the other. The distinct runs of a chunk of texts are found by their 64-bit hashes and each is encoded once. If the parts
below give what the tokenizer gives for PROBES, a run ends before a mark that follows a letter, A-Z count as a-z (not in
chunks with an added token), and a run of common Latin letters and printable ASCII is split into parts here, which go to
the tokenizer's model. Any other run goes through the tokenizer's own normaliser and splitter first.
The ids of recent short runs are remembered in sorted arrays, at most two generations of REMEMBERED runs, which take
about 25 bytes a run.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa

from .textvec import hashed, text_chunks, word_starts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
REMEMBERED, LONGEST = 1 << 19, 64  # runs in each of two generations, and their greatest length in bytes
CHUNK = 1 << 21
MARKS = np.isin(np.arange(256), [*b".,;:!?"])
LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])

LATIN = "ß-öø-ÿ"
SIMPLE = re.compile(f"[!-~À-ÖØ-Þ{LATIN}]*")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")
PROBES = ["Ab,c.", "don't", "I'LL'S", "'s't'rex", "a1b22c", "x--y!!", "ÀÉß-öÿÞ", "été.", "(`~_^)", "|", "$$$12%,", "''ve", "it's(we're)", "Größe"]

_CACHE: dict[str, Encoder] = {}


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a common Latin letter; the first of two counts if the second does."""
    out = LETTERS[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[second < len(data)]
    second = second[(data[second] >= 0x80) & (data[second] <= 0xBF) & (data[second] != 0x97) & (data[second] != 0xB7)]
    out[second] = out[second - 1] = True
    return out


class _Known:
    """Ids by the hash of a run, in sorted arrays."""

    def __init__(self, kind: np.dtype):
        self.key, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not known."""
        if not len(self.key):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def add(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Keys that are sorted and new, and their ids one after the other."""
        place = np.searchsorted(self.key, keys)
        start = len(self.ids) + _before(n)
        self.key, self.at, self.n = np.insert(self.key, place, keys), np.insert(self.at, place, start), np.insert(self.n, place, n)
        self.ids = np.concatenate([self.ids, ids])


def _before(n: np.ndarray) -> np.ndarray:
    """The sum of the items before each."""
    return np.cumsum(n) - n


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them) for each i, one after the other."""
    edge = np.cumsum(n)
    return np.arange(edge[-1] if len(edge) else 0) + np.repeat(start - (edge - n), n)


class Encoder:
    """ids of texts as little-endian unsigned 16-bit (or, for larger vocabularies, 32-bit) numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model, self.normalise, self.split = self.tokenizer.model, self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)").search
        self.any_case = re.compile("|".join(added).encode() or b"(?!)", re.IGNORECASE).search
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.mapped = {ord(c): self.split(c)[0][0] for c in letters}
        self.simple = True
        self.simple = all(self._run(r) == self.tokenizer.encode(r, add_special_tokens=False).ids for r in PROBES)
        self.recent, self.older = _Known(self.kind), _Known(self.kind)

    def _run(self, text: str) -> list[int]:
        """The ids of a run of any characters but ASCII white space."""
        if self.special(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.simple and SIMPLE.fullmatch(text):
            text = text.lower()
            parts = [text] if text.isalpha() else PARTS.findall(text)
            if not text.isascii():
                parts = [p.translate(self.mapped) for p in parts]
        else:
            parts = [p for p, _ in self.split(self.normalise(text))]
        return [t.id for p in parts for t in self.model.tokenize(p)]

    def _encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """The ids of runs of a chunk."""
        if not len(start):
            return []
        at = spread(start, size)
        runs = data[at]
        edge = _before(size)
        kinds = np.logical_and.reduceat(letters(runs), edge).astype(np.int8) + np.logical_and.reduceat(LETTERS[runs], edge) if self.simple else np.zeros(len(start), np.int8)
        text, out, tokenize, mapped = runs.tobytes(), [], self.model.tokenize, self.mapped
        low = text.lower()
        for a, b, kind in zip(edge.tolist(), (edge + size).tolist(), kinds.tolist(), strict=True):
            if kind:  # letters only; 1: some are not ASCII
                run = low[a:b].decode()
                found = tokenize(run if kind == 2 else run.lower().translate(mapped))
                out.append([found[0].id] if len(found) == 1 else [t.id for t in found])
            else:
                out.append(self._run(text[a:b].decode()))
        return out

    def _distinct(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, numbers, ids they count in) of the ids of distinct runs, whose keys are sorted."""
        at = self.recent.find(keys)
        new = np.flatnonzero(at < 0)
        old = self.older.find(keys[new])
        back = np.flatnonzero(old >= 0)  # remembered before, and remembered again
        n, ids = np.zeros(len(new), np.int32), [self.older.ids[spread(self.older.at[old[back]], self.older.n[old[back]])]]
        n[back] = self.older.n[old[back]]
        unseen = np.flatnonzero(old < 0)
        found = self._encoded(data, start[new[unseen]], size[new[unseen]])
        n[unseen] = list(map(len, found))
        ids.append(np.fromiter(chain.from_iterable(found), self.kind, int(n[unseen].sum())))
        order = np.concatenate([back, unseen])
        fresh = np.concatenate(ids)[spread(_before(n[order])[np.argsort(order)], n)]
        base, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        known = np.flatnonzero(at >= 0)
        base[known], count[known] = self.recent.at[at[known]], self.recent.n[at[known]]
        base[new], count[new] = len(self.recent.ids) + _before(n), n
        pool = np.concatenate([self.recent.ids, fresh])
        short = size[new] <= LONGEST
        if len(self.recent.key) + short.sum() > REMEMBERED:
            self.older, self.recent = self.recent, _Known(self.kind)
        self.recent.add(keys[new[short]], n[short], fresh[np.repeat(short, n)])
        return base, count, pool

    def _runs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct run of each run, run offsets of the texts, places, numbers, ids they count in) of a chunk of texts."""
        starts, space, woff = word_starts(data, off)
        plain = self.simple and not self.any_case(data.tobytes())
        if plain and len(starts):
            first = np.zeros(len(data), bool)
            first[starts] = True
            first[1:] |= MARKS[data[1:]] & letters(data)[:-1]
            starts = np.flatnonzero(first)
            woff = np.searchsorted(starts, off)
        keys, size = hashed(data, starts, space, cased=not plain)
        own, first, of = np.unique(keys, return_index=True, return_inverse=True)
        return of, woff, *self._distinct(data, own, starts[first] if len(first) else first, size[first] if len(first) else first)

    def encode_chunk(self, data: np.ndarray, off: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of each text and then end_id, one text after the other; their offsets)."""
        of, woff, base, count, pool = self._runs(data, off)
        run = np.insert(of, woff[1:], len(base))  # the end of each text, too
        base, count = np.append(base, len(pool)), np.append(count, 1)
        n = count[run]
        edge = np.concatenate([[0], np.cumsum(n)])
        return np.append(pool, self.kind.type(end_id))[spread(base[run], n)], edge[np.concatenate([[0], woff[1:] + np.arange(1, len(woff))])]

    def count(self, texts: pa.Array) -> int:
        """How many ids the texts have, their ends included."""
        total = len(texts)
        for _, data, off in text_chunks(texts, CHUNK):
            of, _, _, count, _ = self._runs(data, off)
            total += int(count[of].sum())
        return total

    def columns(self, texts: pa.Array, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of neighbouring texts; null is empty."""
        for i, data, off in text_chunks(texts, CHUNK):
            yield i, *self.encode_chunk(data, off, end_id)

    def encode(self, text: str | None, end_id: int = END_ID) -> bytes:
        """The ids of one text, then end_id; null is empty."""
        return b"".join(ids.tobytes() for _, ids, _ in self.columns(pa.array([text], pa.string()), end_id))


def encoder(path: str = WORD_BPE) -> Encoder:
    """The encoder of a file, one in each worker."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]
