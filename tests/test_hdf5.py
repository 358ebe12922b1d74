"""HDF5 files made here and read back by ranges of rows."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest

from tesserae.sources import hdf5


@pytest.mark.parametrize("chunk", [0, 7, 100])
def test_datasets_by_ranges(chunk):
    rng = np.random.default_rng(1)
    arrays = {"bytes": rng.integers(0, 255, 3000).astype(np.uint8), "wide": rng.integers(-9, 9, (450, 5)).astype(np.int32), "real": rng.normal(size=60), "small": rng.normal(size=60).astype(np.float32), "none": np.zeros((0, 3), np.int16)}
    arrays |= {f"n{i:02d}": np.array([i], np.uint16) for i in range(20)}  # more than a node of names holds
    source = io.BytesIO(hdf5.make_file({"a": {"b": arrays}, "top": np.arange(5, dtype=np.int64)}, chunk))
    file = hdf5.File(source)
    assert file.dataset("/top").rows(1, 4).tolist() == [1, 2, 3]
    assert file.dataset("a/x") is None and file.dataset("a/b/bytes/x") is None and file.find("no") is None
    for name, a in arrays.items():
        own = file.dataset(f"a/b/{name}")
        assert own.shape == a.shape and own.kind == a.dtype
        for _ in range(20):
            i, j = sorted(rng.integers(0, len(a) + 2, 2).tolist())
            assert (own.rows(i, j) == a[i:j]).all() and own.rows(i, j).shape == a[i:j].shape


def test_few_bytes_are_read():
    class Counting(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            Counting.seen += n
            return super().read(n)

    data = np.random.default_rng(2).integers(0, 255, 1_000_000).astype(np.uint8)
    file = hdf5.File(Counting(hdf5.make_file({"d": data}, 1000)))
    assert (file.dataset("d").rows(500_100, 500_200) == data[500_100:500_200]).all()
    assert Counting.seen < 30_000


def test_what_cannot_be_read_fails():
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.File(io.BytesIO(b"x" * 200))
    good = hdf5.make_file({"d": np.arange(1000)})
    with pytest.raises(ValueError, match="cut off"):
        hdf5.File(io.BytesIO(good[:3000])).dataset("d").rows(0, 1000)


def test_holes_bases_and_regions(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = []
    for hole in range(200):
        bases = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 400, 2000])))
        regions = sorted(((a := rng.randint(0, 50)), a + rng.randint(0, 50), rng.choice(hdf5.REGION_TYPES), rng.randint(0, 1000)) for _ in range(rng.randint(0, 3)))
        rows.append((hole, hole // 10, hole % 10, hole % 3, bases, [(t, a, b, q) for a, b, t, q in regions]))
    df = spark.createDataFrame(rows, "hole int, x int, y int, status int, bases string, regions array<struct<type:string,start:int,stop:int,quality:int>>")
    folder = f"file://{tmp_path}/calls"
    made = hdf5.write_calls(df.repartitionByRange(3, "hole").sortWithinPartitions("hole"), folder, 500).collect()
    assert sum(r["holes"] for r in made) == 200 and len(made) == 3
    found = hdf5.read_zmw(spark, folder).orderBy("hole").collect()
    assert [(r["hole"], r["x"], r["y"], r["status"], r["bases"], [tuple(g) for g in r["regions"]]) for r in found] == rows
    assert {(r["qualities"], r["pre_frames"]) for r in found} == {(None, None)}
    index = hdf5.hole_index(spark, folder)
    some = hdf5.read_calls(index.where("hole in (5, 6, 150)")).orderBy("hole").collect()
    assert [(r["hole"], r["bases"]) for r in some] == [(h, rows[h][4]) for h in (5, 6, 150)]
    assert hdf5.hole_index(spark, folder, hdf5.CONSENSUS).count() == 0


def test_qualities_frames_and_consensus(spark, tmp_path):
    zmw = {"HoleNumber": np.array([70_001, 5], np.uint32), "NumEvent": np.array([3, 2], np.int32)}
    calls = {"Basecall": np.frombuffer(b"ACGTT", np.uint8), "QualityValue": np.arange(5, dtype=np.uint8), "PreBaseFrames": np.arange(5, dtype=np.uint16), "WidthInFrames": np.arange(5, 10, dtype=np.uint16), "ZMW": zmw}
    (tmp_path / "a.h5").write_bytes(hdf5.make_file({"PulseData": {"ConsensusBaseCalls": calls}}))
    index = hdf5.hole_index(spark, str(tmp_path), hdf5.CONSENSUS)
    rows = hdf5.read_calls(index, hdf5.CONSENSUS).orderBy("hole").collect()
    assert [(r["hole"], r["x"], r["y"], r["bases"], bytes(r["qualities"]), r["pre_frames"], r["width_frames"]) for r in rows] == [(5, 0, 5, "TT", b"\3\4", [3, 4], [8, 9]), (70_001, 1, 4465, "ACG", b"\0\1\2", [0, 1, 2], [5, 6, 7])]
    assert hdf5.read_zmw(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("chunk", [0, 3])
def test_traces(spark, tmp_path, chunk):
    rng = np.random.default_rng(4)
    traces, table = rng.integers(0, 256, (10, 4, 30)).astype(np.uint8), np.arange(256, dtype=np.float32) * 2
    tree = {"TraceData": {"HoleNumber": np.arange(100, 110, dtype=np.uint32), "Traces": traces, "Codec": {"Decode": table}}}
    (tmp_path / "a.h5").write_bytes(hdf5.make_file(tree, chunk, {"Decode": {"Bias": 7, "Other": 1}}))
    found = {(r["hole"], r["channel"]): r["trace"] for r in hdf5.read_traces(spark, str(tmp_path), 4).collect()}
    assert len(found) == 40
    assert all(found[100 + h, c] == [2.0 * v - 7 for v in traces[h, c].tolist()] for h in range(10) for c in range(4))


def test_a_partition_makes_files_of_bounded_size(spark, tmp_path):
    regions = "array<struct<type:string,start:int,stop:int,quality:int>>"
    rows = [(h, 1, h, 0, None if h == 3 else "AC\u00e9" * (1 + h % 5), [("Insert", 0, h, 1), ("HQRegion", 0, h, 900)] if h % 4 else None) for h in range(50)]
    df = spark.createDataFrame(rows, f"hole int, x int, y int, status int, bases string, regions {regions}").coalesce(1)
    for k, limits in enumerate(({"holes": 7}, {"bases": 20}, {"holes": 3, "bases": 1})):
        made = hdf5.write_calls(df, f"file://{tmp_path}/f{k}", 16, **limits).collect()
        assert sum(m["holes"] for m in made) == 50
        assert max(m["holes"] for m in made) <= limits.get("holes", 50) and len(made) >= (8, 10, 50)[k]
        read = {r["hole"]: r for r in hdf5.read_zmw(spark, f"file://{tmp_path}/f{k}").collect()}
        assert len(read) == 50
        for h, x, y, status, bases, own in rows:
            r = read[h]
            assert (r["x"], r["y"], r["status"], r["bases"]) == (x, y, status, bases or "")
            assert sorted((g["type"], g["start"], g["stop"], g["quality"]) for g in r["regions"]) == sorted(own or [])


def test_regions_are_not_broadcast(spark, tmp_path):
    regions = "array(struct('Insert' as type, 1 as start, 5 as stop, 0 as quality), struct('HQRegion' as type, 0 as start, 9 as stop, cast(id % 1000 as int) as quality))"
    df = spark.range(20_000).selectExpr("cast(id as int) as hole", "0 as x", "0 as y", "0 as status", "repeat('A', 10) as bases", f"{regions} as regions")
    folder = f"file://{tmp_path}/calls"
    hdf5.write_calls(df.repartitionByRange(3, "hole"), folder)
    own = spark.newSession()
    # the list of three files is smaller than that, their regions are larger
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    own.conf.set("spark.sql.maxBroadcastTableSize", "100k")
    found = hdf5.read_zmw(own, folder).selectExpr("hole", "bases", "regions[0].quality as q", "size(regions) as n").collect()
    assert sorted(map(tuple, found)) == [(h, "A" * 10, h % 1000, 2) for h in range(20_000)]
