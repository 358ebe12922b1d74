"""BPE encoding by a streaming transducer of bounded lookahead, and decoding by an incremental byte-to-text machine.

Merges run in the order of the list, so what follows a prefix of a word reaches back only through chains of rules: if
the tokens of two words agree up to some place, the next rule (u, v) moves that place back by the length of u and no
more, and only if v is, or starts with, what stood right of the place before. The longest such chain, found once from
the list, is the sufficient lookahead: tokens that end that many bytes before the last byte read are the same whatever
follows. The transducer therefore emits them, forgets their bytes and goes on from there; it holds `lookahead` and
`BLOCK` bytes of a word of any length. Nothing of the kind holds where a rule uses a token that a later rule makes;
such lists are refused.

Words of at most SHORT bytes advance side by side as lanes of arrays, the least rule of each at a time; longer ones go
through `Stream`. What is not merging (normaliser, splitting, added tokens) follows the file: words of a chunk are
found by their hashes and each distinct one goes through the transducer once (`tokens.Encoder`); for files that keep
white space the splitter of the library gets whole texts.

Decoding follows the file's decoder. Without one, tokens are joined by a space. With the byte-level one, token bytes
form UTF-8; a byte sequence is text once it is whole, what cannot become whole is U+FFFD, and the state between pieces
is the few bytes of an unfinished character.

Null and empty texts have no ids and decode to the empty text. Repeated rows and ids are rows of their own, null ids
stay. An empty table gives an empty one. Other columns are not read, and the result's names are its own. Texts of any
length are taken whole; one row is worked on alone, so nothing is shuffled.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LETTERS, PARTS, SIMPLE, WORD_BPE, Encoder, _before, spread

SHORT, BLOCK = 64, 4096
NONE = np.int64(1 << 40)
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_CACHE: dict[str, StreamEncoder] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies: itself if it prints, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """How many letters after a token's end decide that it stays, for rules in the order they apply.

    reach[t]: how far back a place may have moved when t stands left of where it was; a rule (u, v) goes on from any t
    that v starts with as merged, and v's own starts are those of the rule that makes it.
    """
    made = {u + v: i for i, (u, v) in enumerate(merges)}
    if len(made) < len(merges) or any(made.get(t, -1) >= i for i, rule in enumerate(merges) for t in rule):
        raise ValueError("a rule uses a token that a later rule makes")
    left = {u + v: u for u, v in merges}
    reach: dict[str, int] = {}
    for u, v in merges:
        before, t = 0, v
        while t is not None:
            before, t = max(before, reach.get(t, 0)), left.get(t)
        reach[u] = max(reach.get(u, 0), before + len(u.removesuffix(suffix) if suffix else u))
    return max(reach.values(), default=0)


class Transducer:
    """The rules of a tokenizer file as sorted arrays."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE models")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, suffix)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank = np.append(key[order], np.int64(1 << 62)), np.append(order, NONE).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = {(k >> 32, k & 0xFFFFFFFF): i for i, k in enumerate(key.tolist())}
        names = byte_letters()
        self.inner, self.final = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in names:
            self.inner[ord(c)], self.final[ord(c)] = vocab.get(c, -1), vocab.get(c + suffix, -1)
        self.length = np.ones(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.length[i] = len(t.removesuffix(suffix) if suffix else t)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = a << 32 | b
        at = np.searchsorted(self.key, own)
        return np.where(self.key[at] == own, self.rank[at], NONE)

    def _lanes(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many each lane has) of lanes of at least one symbol."""
        lane = np.repeat(np.arange(len(off) - 1), np.diff(off))
        rank = np.full(len(ids), NONE)
        inner = np.flatnonzero(lane[1:] == lane[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        done_ids, done_lane = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == NONE, size)
            if over.any():
                done_ids.append(ids[over])
                done_lane.append(lane[over])
                ids, lane, rank = ids[~over], lane[~over], rank[~over]
                least, size = least[least < NONE], size[least < NONE]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            run = np.concatenate([[True], np.diff(at) > 1])  # in a run of equal symbols every other pair merges
            at = at[(at - at[run][np.cumsum(run) - 1]) % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            now = np.cumsum(stay)[at] - 1
            rank[at] = rank[at + 1]  # still a last symbol, or found again below
            ids, lane, rank = ids[stay], lane[stay], rank[stay]
            pair = np.unique(np.concatenate([now, now - 1]))
            pair = pair[(pair >= 0) & (pair < len(ids) - 1)]
            pair = pair[lane[pair] == lane[pair + 1]]
            rank[pair] = self._ranks(ids[pair], ids[pair + 1])
        ids, lane = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_lane))
        order = np.argsort(lane, kind="stable")
        return ids[order], np.bincount(lane, minlength=len(off) - 1)

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of one run of symbols, by a heap of its pairs."""
        ids, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        n = len(ids)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := pairs.get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (r, p))
        return [t for t in ids if t >= 0]

    def encode(self, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the words one after the other, how many each has); a word is code points of byte letters, none empty."""
        size = np.diff(off)
        symbols = self.inner[codes]
        symbols[off[1:] - 1] = self.final[codes[off[1:] - 1]]
        if (symbols < 0).any():
            raise ValueError("a byte has no token")
        short = np.flatnonzero(size <= SHORT)
        own, n = self._lanes(symbols[spread(off[short], size[short])], np.append(0, np.cumsum(size[short])))
        if len(short) == len(size):
            return own, n
        count = np.zeros(len(size), np.int64)
        count[short] = n
        found = {}
        for w in np.flatnonzero(size > SHORT).tolist():
            stream, a, b = Stream(self), int(off[w]), int(off[w + 1])
            out = [t for i in range(a, b, BLOCK) for t in stream.feed(codes[i : min(i + BLOCK, b)])] + stream.close()
            found[w], count[w] = out, len(out)
        out, start = np.zeros(int(count.sum()), np.int64), _before(count)
        out[spread(start[short], n)] = own
        for w, own in found.items():
            out[start[w] : start[w] + len(own)] = own
        return out, count


class Stream:
    """One word, read piece by piece; at most `lookahead` and two blocks of its symbols are held."""

    def __init__(self, rules: Transducer, block: int = BLOCK):
        self.rules, self.block, self.held, self.last = rules, block, [], None

    def feed(self, codes: np.ndarray) -> list[int]:
        """The tokens that are certain now, after more letters."""
        if not len(codes):
            return []
        if self.last is not None:  # it was not the last letter of the word
            self.held.append(int(self.rules.inner[self.last]))
        self.held += self.rules.inner[codes[:-1]].tolist()
        self.last = int(codes[-1])
        if len(self.held) < self.rules.lookahead + self.block:
            return []
        tokens = self.rules.merge(self.held)
        end = np.cumsum(self.rules.length[tokens])
        n = int(np.searchsorted(end, len(self.held) - self.rules.lookahead, "right"))
        if n:
            del self.held[: int(end[n - 1])]
        return tokens[:n]

    def close(self) -> list[int]:
        """The tokens of the rest, the word being over."""
        rest = self.held + ([int(self.rules.final[self.last])] if self.last is not None else [])
        self.held, self.last = [], None
        return self.rules.merge(rest)


class StreamEncoder(Encoder):
    """ids of texts as the file's tokenizer gives them, all merges by the transducer."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.rules, self.decoder = Transducer(spec["model"]), TextDecoder(spec)
        words = bool(spec["model"].get("end_of_word_suffix") and spec["normalizer"])
        if words:
            super().__init__(path)
        else:
            self._whole(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_words = words and ids(" \t\n ") == [] and ids("ab cd\ne") == ids("ab") + ids("cd") + ids("e")
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def _whole(self, path: str) -> None:
        """What texts need that are not taken word by word."""
        from tokenizers import Tokenizer

        self.tokenizer, self.simple = Tokenizer.from_file(path), False
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)").search

    def _parts(self, text: str) -> list[str | int]:
        """Words of byte letters, and ids of added tokens, of a text in which white space may occur."""
        out: list[str | int] = []
        while text:
            found = self.special(text)
            own = text[: found.start()] if found else text
            if self.simple and SIMPLE.fullmatch(own):
                low = own.lower()
                words = [low] if low.isalpha() else PARTS.findall(low)
                out += words if low.isascii() else [p.translate(self.mapped) for p in words]
            elif own:
                out += [p for p, _ in self.split(self.normalise(own))]
            if not found:
                return out
            out.append(self.added[found[0]])
            text = text[found.end() :]
        return out

    def _transduced(self, parts: list[list[str | int]]) -> list[list[int]]:
        """The ids of runs that were cut into parts."""
        words = [p for own in parts for p in own if isinstance(p, str) and p]
        codes = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")
        off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int64)
        ids, n = self.rules.encode(codes, off) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, edge, w, out = ids.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist(), 0, []
        for own in parts:
            made: list[int] = []
            for p in own:
                if isinstance(p, int):
                    made.append(p)
                elif p:
                    made += ids[edge[w] : edge[w + 1]]
                    w += 1
            out.append(made)
        return out

    def _encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """The ids of the distinct new runs of a chunk: those of plain letters straight from their bytes."""
        if not len(start):
            return []
        runs = data[spread(start, size)]
        edge = _before(size)
        plain = np.logical_and.reduceat(LETTERS[runs], edge) if self.simple else np.zeros(len(start), bool)
        words = np.flatnonzero(plain)
        out: list[list[int]] = [[]] * len(start)
        if len(words):
            codes = (runs[spread(edge[words], size[words])] | 32).astype(np.int64)
            ids, n = self.rules.encode(codes, np.append(0, np.cumsum(size[words])))
            ids, end = ids.tolist(), np.cumsum(n).tolist()
            for w, a, b in zip(words.tolist(), [0, *end[:-1]], end, strict=True):
                out[w] = ids[a:b]
        others, text = np.flatnonzero(~plain).tolist(), runs.tobytes()
        found = self._transduced([self._parts(text[edge[w] : edge[w] + size[w]].decode()) for w in others])
        for w, own in zip(others, found, strict=True):
            out[w] = own
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of neighbouring texts, without an end id; null is empty."""
        if self.by_words:
            for first, ids, off in self.columns(column):
                row = np.arange(len(off))
                yield first, np.delete(ids, off[1:] - 1), off - row
            return
        for i, text in enumerate(column.to_pylist()):
            ids = self._transduced([self._parts(text or "")])[0]
            yield i, np.array(ids, self.kind), np.array([0, len(ids)])


class TextDecoder:
    """Token ids to text by the decoder that a tokenizer file names: none, or the byte-level one."""

    def __init__(self, spec: dict):
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind}")
        self.joined = kind is None
        of = {c: b for b, c in enumerate(byte_letters())}
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        items = [names.get(i) for i in range(max(names) + 1)]
        if self.joined:
            parts = [b"" if t is None else b" " + t.encode() for t in items]
        else:
            parts = [b"" if t is None else bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in items]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = _before(self.size)
        self.pool = np.frombuffer(b"".join(parts), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of tokens one after the other, their offsets)."""
        if len(ids) and (int(ids.max()) >= len(self.size)):
            raise ValueError("an id has no token")
        n = self.size[ids]
        return self.pool[spread(self.start[ids], n)], np.concatenate([[0], np.cumsum(n)])

    def stream(self) -> DecodeStream:
        return DecodeStream(self)


class DecodeStream:
    """Pieces of ids to pieces of text; holds an unfinished character only."""

    def __init__(self, decoder: TextDecoder):
        self.decoder, self.first = decoder, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        data, _ = self.decoder.bytes_of(ids)
        return self.push(data.tobytes(), len(ids))

    def push(self, data: bytes, n: int) -> str:
        """Text after the bytes of n more tokens."""
        if self.first and n:
            self.first = False
            data = data[1:] if self.decoder.joined else data  # no space before the first token
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", final=True)


def stream_encoder(path: str = WORD_BPE) -> StreamEncoder:
    """The encoder of a file, one in each worker."""
    if path not in _CACHE:
        _CACHE[path] = StreamEncoder(path)
    return _CACHE[path]


PIECE = 1 << 20  # bytes of decoded text at once


def _digests(own: StreamEncoder, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
    for _, ids, off in own.texts(texts):
        wide, edge = ids.astype("<u4"), off.tolist()
        data, at = own.decoder.bytes_of(ids.astype(np.int64))
        flat, cut = data.tobytes(), at[off].tolist()
        for a, b, x, y in zip(edge[:-1], edge[1:], cut[:-1], cut[1:], strict=True):
            digest, stream = hashlib.sha256(), own.decoder.stream()
            for i in range(x, y, PIECE):
                digest.update(stream.push(flat[i : min(i + PIECE, y)], b - a).encode())
            digest.update(stream.close().encode())
            yield b - a, hashlib.sha256(wide[a:b].tobytes()).hexdigest(), digest.hexdigest()


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = stream_encoder(path)
        for batch in batches:
            n, ids, text = (list(c) for c in zip(*_digests(own, batch.column(1)), strict=True)) if len(batch) else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = stream_encoder(path)
        for batch in batches:
            rows = [ids[a:b].astype(np.int32) for _, ids, off in own.texts(batch.column(1)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = stream_encoder(path)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                stream = own.decoder.stream()
                out.append(None if ids is None else stream.feed(np.array(ids, np.int64)) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def _two(df: DataFrame, id_col: str, col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).alias(name))


def encode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each whole text, as the file's tokenizer gives them without special tokens added."""
    return _two(docs, id_col, text_col, "text").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each list of ids, special tokens written out; null stays null."""
    return _two(encoded, id_col, ids_col, "ids").mapInArrow(_texts(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256 (of the decoded text in UTF-8)."""
    return _two(docs, id_col, text_col, "text").mapInArrow(_run(path), ENCODED)
