from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm import feistel_output
from tesserae.llm.bm25_packing import Index, keys, pack, pack_shard, ranks
from tesserae.llm.feistel_output import Feistel, materialise
from tesserae.llm.tokens import Encoder, WORD_BPE, encoder

from .helpers import docs


def _ids(text):
    return [*encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["", "a", "don't I'LL x'S 123abc ½", "<|endoftext|>a b<|x|> İSTANBUL ΣΑΣ ﬁ é x y \x1ca", "漢字かな 😀", "Größe ÀÉß-öÿÞ", "à" * 300, "x" * 5000]


def test_encoder_equals_the_tokenizer():
    own = Encoder(WORD_BPE)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abT'.,-é 1ß\n\t$") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):
        assert all(np.frombuffer(own.encode(t), own.kind).tolist() == _ids(t) for t in texts)


def _rows():
    rng = random.Random(3)
    topics = [[f"{t}{c}" for c in "abcdefghij"] for t in ("sea", "hill", "fire")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.choice([3, 40, 300])))) for i in range(60)]
    return rows + list(enumerate(TEXTS, 1000)) + [(2000, None), (None, "no id"), (5, "other text"), (7, rows[7][1]), (7, rows[7][1]), (3000, "long words here " * 4000)]


def test_packing_is_whole_and_full(spark):
    rows = _rows()
    found = pack(docs(spark, rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == 2048 or at & (at - 1) == 0
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(_ids(t))
    assert set(pieces) == set(texts)
    for i, expected in texts.items():
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        for ids in expected:
            cut = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[i] if r["doc_tokens"] == len(ids))
            assert sum(n for _, n, _ in cut) == len(ids) * sum(len(x) == len(ids) for x in expected)
            assert all(c == crc(ids[s : s + n]) for s, n, c in cut)
    assert pack(docs(spark, [])).count() == 0


def test_bm25_against_plain_scores():
    rng = random.Random(2)
    data = [np.array([rng.randrange(30) for _ in range(rng.randint(1, 40))]) for _ in range(25)]
    index, n = Index(data), len(data)
    mean = sum(map(len, data)) / n
    for seed in range(n):
        got = index.scores(seed)
        for d in range(n):
            score = 0.0
            for term in set(data[seed].tolist()):
                df = sum(term in set(x.tolist()) for x in data)
                tf = (data[d] == term).sum()
                idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(data[d]) / mean)) if tf else 0
            assert got[d] == pytest.approx(score)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        order = Feistel(n, key=5)
        slots = order.slot(np.arange(n, dtype=np.uint64))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.sequence(slots.astype(np.uint64)) == np.arange(n)).all()
    assert (Feistel(1000, 1).slot(np.arange(1000)) != Feistel(1000, 2).slot(np.arange(1000))).any()


def test_shards_round_trip(spark, tmp_path):
    rows = _rows()
    made = materialise(docs(spark, rows).repartition(3), folder=f"file://{tmp_path}/out", length=64, shard_slots=50)
    back = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in made.read().collect()}
    assert sorted(back) == list(range(made.n))
    sequence = made.order.sequence(np.arange(made.n, dtype=np.uint64))
    stream = np.concatenate([back[s] for s in np.argsort(sequence)]).tolist()
    parts, text = [], stream
    for end in range(len(text)):
        if text[end] == 1 or end == len(text) - 1:
            parts.append(end)
    # every document's ids lie in one piece in the restored order
    joined = ",".join(map(str, stream))
    assert all(",".join(map(str, _ids(t))) in joined for _, t in rows)
    files = sorted((tmp_path / "out").glob("shard-*.bin"))
    assert len(files) == -(-made.n // 50) and all(f.stat().st_size == 50 * 128 for f in files[:-1])
    later = list(feistel_output.read_shard(made.folder, 0, 64, start=7))
    assert len(later) == 43 and (later[0] == back[7]).all()
    found = made.verified().collect()
    assert {i for r in found for i in r["doc_ids"]} == {i for i, _ in rows}
    assert [r["ids_crc32"] for r in sorted(found, key=lambda r: r["slot"])] == [zlib.crc32(back[s].astype("<u4").tobytes()) for s in range(made.n)]
    assert materialise(docs(spark, [])).verified().count() == 0


def test_a_damaged_shard_is_found(spark, tmp_path):
    made = materialise(docs(spark, [(1, "some text here")]), folder=f"file://{tmp_path}/out", length=8, shard_slots=4)
    shard = next((tmp_path / "out").glob("*.bin"))
    raw = bytearray(shard.read_bytes())
    raw[0] ^= 1
    shard.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="differs from what was written"):
        made.verified().collect()


def test_windows_take_the_best_unused_neighbours():
    """pack_shard against a plain replay: the seed, then neighbours by score until the window is full."""
    rng = random.Random(11)
    data = [np.array([rng.randrange(40) for _ in range(rng.randint(1, 30))]) for _ in range(60)]
    window, index = 32, Index(data)
    expected, left, queue, sequence = [], list(range(len(data))), None, 0
    while left or queue:
        seed, start = queue or (left.pop(0), 0)
        queue, own, used = None, [(seed, start)], 0
        ranked = sorted(left, key=lambda d: (-index.scores(seed)[d], d))
        pieces = []
        while used < window and (own or ranked):
            if not own:
                own = [(ranked.pop(0), 0)]
                left.remove(own[0][0])
            d, begin = own.pop()
            n = min(window - used, len(data[d]) - begin)
            pieces.append((d, begin, n, sequence, used))
            used += n
            queue = (d, begin + n) if begin + n < len(data[d]) else None
        if used < window:
            break
        expected += pieces
        sequence += 1
    found = list(pack_shard(data, window))
    assert [p for p in found if p[3] < sequence] == expected
    rest = [p for p in found if p[3] >= sequence]
    assert sum(p[2] for p in rest) == sum(map(len, data)) - window * sequence


def test_keys_are_the_least_ranks():
    rng = random.Random(12)
    data = [np.array([rng.randrange(50) for _ in range(rng.randint(1, 20))], np.uint16) for _ in range(40)]
    df = np.array([sum(t in set(d.tolist()) for d in data) for t in range(60)])
    rank = ranks(df, len(data))
    assert sorted(rank.tolist()) == list(range(60))
    single = [t for t in range(60) if df[t] <= 1 or 2 * df[t] > len(data)]
    assert min((rank[t] for t in single), default=60) >= 60 - len(single)
    found = keys(np.concatenate(data), np.cumsum([0, *map(len, data)]), rank)
    for d, own in zip(data, found.tolist(), strict=True):
        least = sorted({int(rank[t]) for t in d.tolist()})[:4]
        assert own == least + [60] * (4 - len(least))


def test_a_shard_has_a_slot_for_each_sequence(spark):
    """Tokens, padding and partition ends: a partition's sequences are full but for its last."""
    rows = [(i, "word " * (3 * i)) for i in range(40)]
    made = materialise(docs(spark, rows).repartition(3), length=16, shard_slots=8)
    tokens = [len(_ids(t)) for _, t in rows]
    blocks = [np.frombuffer(r["ids"], "<u2") for r in made.read().collect()]
    assert len(blocks) == made.n and all(len(b) == 16 for b in blocks)
    padded = [b for b in blocks if b[-1] == 0]
    assert len(padded) <= 3 and sum(int((b != 0).sum()) for b in blocks) == sum(tokens)
