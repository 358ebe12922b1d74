"""The transducer against the library's own tokenizer, its lookahead against plain merging, and decoding."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm import bpe_stream

from .helpers import docs

FILES = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
PARTS = ["a", "b", "the", "in", "tion", "ing", " ", "'s", "1", "é", "é", "!", "<|endoftext|>", "\n", "ß", "Z", "日本", "\U0001f4a9", "\x00", " "]


def texts(seed, n=60):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    return [*made, letters, "a" * 9000, "ab" * 6000, "hello" * 3000, "é" * 5000, "\U0001f4a9" * 3000, "<|ENDOFTEXT|>", "it's'S 'LL we'RE", " "]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("path", FILES)
def test_round_trip_as_the_library(spark, path):
    rows = [(1, None), (2, ""), (2, "again the same id"), (None, "no id"), (3, "same"), (3, "same")] + [(10 + i, t) for i, t in enumerate(texts(1))]
    found = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_stream.round_trip(docs(spark, rows), path).collect())
    library = Tokenizer.from_file(path)
    assert found == sorted((i or -1, *expected(library, t)) for i, t in rows)


def test_ids_and_texts(spark):
    library = Tokenizer.from_file(FILES[1])
    rows = [(i, t) for i, t in enumerate(texts(2, 20))]
    encoded = bpe_stream.encode(docs(spark, rows), FILES[1])
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    decoded = {r["doc_id"]: r["text"] for r in bpe_stream.decode(encoded, FILES[1]).collect()}
    assert decoded == dict(rows)
    assert bpe_stream.encode(docs(spark, []), FILES[1]).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe_stream.decode(null, FILES[1]).first()["text"] is None


@pytest.mark.parametrize("path", FILES)
def test_emitted_tokens_are_final_and_memory_is_bounded(path):
    rules = bpe_stream.stream_encoder(path).rules
    rng = random.Random(3)
    for word in ("".join(rng.choice(["in", "th", "an", "e", "r", "ing", "s", "ed", "zz"]) for _ in range(1500)), "a" * 3000, "".join(rng.choice("etaoin") for _ in range(3000))):
        codes = np.frombuffer(word.encode(), np.uint8)
        symbols = rules.inner[codes].tolist()
        whole = rules.merge([*symbols[:-1], int(rules.final[codes[-1]])])
        stream, out = bpe_stream.Stream(rules, block=1), []
        for i in range(0, len(codes), 7):
            out += stream.feed(codes[i : i + 7])
            assert out == whole[: len(out)]
            assert len(stream.held) <= rules.lookahead + 1 + 7 + 64
        assert len(out) and out + stream.close() == whole


def test_lookahead_of_a_small_list():
    # (c, d) decides (b, cd), which decides (a, bcd): three letters back
    assert bpe_stream.sufficient_lookahead([("c", "d")]) == 1
    assert bpe_stream.sufficient_lookahead([("c", "d"), ("b", "cd"), ("a", "bcd")]) == 3
    assert bpe_stream.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # either b goes right, or a takes it
    assert bpe_stream.sufficient_lookahead([]) == 0
    with pytest.raises(ValueError):
        bpe_stream.sufficient_lookahead([("ab", "c"), ("a", "b")])


def test_unfinished_characters_wait():
    decoder = bpe_stream.stream_encoder(FILES[1]).decoder
    ids = Tokenizer.from_file(FILES[1]).encode("日本é\U0001f4a9", add_special_tokens=False).ids
    stream = decoder.stream()
    pieces = [stream.feed([i]) for i in ids]
    assert "�" not in "".join(pieces) and "".join(pieces) + stream.close() == "日本é\U0001f4a9"
    cut = decoder.stream()
    assert cut.feed(ids[:1]) + cut.close() in ("日", "�")
    with pytest.raises(ValueError):
        decoder.stream().feed([10**6])
