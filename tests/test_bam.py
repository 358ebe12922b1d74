"""BAM files written and read back by ranges, against what was put in; stitching of subreads beside scraps."""

from __future__ import annotations

import io
import random
import shutil

import pytest

from tesserae.operators import holes
from tesserae.sources import bam


def molecule(rng, hole):
    """(name, bases, tags, qualities) of the parts of a read, in order, and whether each is a scrap."""
    at, out = rng.choice([0, 0, 30]), []
    for kind in ["L", *["x", "A"] * rng.randint(0, 3), "x", "L"][rng.randint(0, 1) :]:
        n = rng.randint(1, 900)
        tags = [("zm", "i", hole), ("qs", "i", at), ("qe", "i", at + n), ("rq", "f", 0.875)]
        tags += [("cx", "C", 2)] if kind == "x" else [("sc", "A", kind), ("sz", "A", "N")]
        tags += [("sn", "Bf", [1.5, 2.0]), ("RG", "Z", "group")]
        bases = "".join(rng.choice("ACGT") for _ in range(n))
        out.append((f"cell/{hole}/{at}_{at + n}", bases, tags, bytes(rng.randrange(40) for _ in range(n)) if rng.random() < 0.5 else None, kind != "x"))
        at += n
    return out


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("bam")
    parts = [p for hole in range(65_530, 65_600) for p in molecule(rng, hole)]
    for kind, scrap in (("subreads", False), ("scraps", True)):
        own = [(i, bytearray(bam.encode(*p[:4]))) for i, p in enumerate(parts) if p[4] == scrap]
        df = spark.createDataFrame(own, "i int, record binary").coalesce(1).sortWithinPartitions("i")
        made = bam.write_bam(df, f"file://{folder}/{kind}", "@HD\tVN:1.6\n").collect()
        assert [r["records"] for r in made] == [len(own)]
        shutil.move(f"{folder}/{kind}/part-00000.bam", f"{folder}/movie.{kind}.bam")
    return folder, parts


@pytest.mark.parametrize("block", [3000, 20_000, 70_000, 1 << 26])
def test_round_trip_by_ranges(spark, files, block):
    folder, parts = files
    rows = bam.read_bam(spark, f"{folder}/movie.subreads.bam", block).orderBy("place").collect()
    expected = [p for p in parts if not p[4]]
    assert [(r["name"], r["bases"], r["qualities"] and bytes(r["qualities"])) for r in rows] == [(p[0], p[1], p[3]) for p in expected]
    assert rows[0]["tags"]["sn"] == "1.5,2.0" and rows[0]["tags"]["RG"] == "group" and rows[0]["flag"] == 4
    assert [bytes(r["record"]) for r in rows] == [bam.encode(*p[:4]) for p in expected]
    assert bam.header_text(spark, f"{folder}/movie.subreads.bam") == "@HD\tVN:1.6\n"


def test_long_records_cross_ranges():
    long = bam.encode("long/1/0_1", "ACGT" * 60_000, [])
    body = bam.MAGIC + (0).to_bytes(4, "little") + (0).to_bytes(4, "little") + b"".join([bam.encode("a/1/0_4", "ACGT", []), long, bam.encode("b/1/0_2", "AC", [("zm", "i", 1)])] * 3)
    data = b"".join(bam.deflate(body[i : i + 5000]) for i in range(0, len(body), 5000)) + bam.END
    for step in (700, 9000, len(data)):
        found = [r for a in range(0, len(data), step) for r in bam.records_of(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert [bam.decode(r)[0] for _, r in found] == ["a/1/0_4", "long/1/0_1", "b/1/0_2"] * 3
        assert len({p for p, _ in found}) == 9


def test_what_is_no_bam_fails():
    with pytest.raises(ValueError, match="no block"):
        list(bam.records_of(io.BytesIO(b"x" * 100), 100, 0, 100))
    data = bam.deflate(b"text") + bam.END
    with pytest.raises(ValueError, match="not a BAM"):
        list(bam.records_of(io.BytesIO(data), len(data), 0, len(data)))
    cut = bam.deflate(bam.MAGIC + bytes(8) + bam.encode("a", "ACGT", [])[:-3]) + bam.END
    with pytest.raises(ValueError, match="cut off"):
        list(bam.records_of(io.BytesIO(cut), len(cut), 0, len(cut)))


def test_alignments_have_operations():
    record = bam.encode("r", "ACGTA", [], b"\1\2\3\4\5", 0, 0, 7, 60, [(3, "M"), (1, "I"), (1, "S")])
    assert bam.decode(record)[:8] == ("r", 0, 0, 7, 60, "3M1I1S", "ACGTA", b"\1\2\3\4\5")


def test_pair_and_stitch(spark, files):
    folder, parts = files
    rows = bam.read_pair(spark, f"{folder}/movie.subreads.bam", 20_000)
    found = {r["hole"]: r for r in holes.stitch_sources(rows).collect()}
    by_hole = {}
    for p in parts:
        by_hole.setdefault(dict((t[0], t[2]) for t in p[2])["zm"], []).append(p)
    assert set(found) == set(by_hole)
    for hole, own in by_hole.items():
        r, tags = found[hole], [dict((t[0], t[2]) for t in p[2]) for p in own]
        assert r["bases"] == "".join(p[1] for p in own) and (r["x"], r["y"], r["status"]) == (hole >> 16, hole & 0xFFFF, 0)
        first, end, low = tags[0]["qs"], tags[-1]["qe"], [(t["qs"], t["qe"]) for t in tags if t.get("sc") == "L"]
        high = [x for x in r["regions"] if x["type"] == "HQRegion"]
        expected = (low[0][1] if low[0][0] == first else first, end if low[0][1] != end and len(low) == 1 else low[-1][0])
        assert [(x["start"] + first, x["stop"] + first, x["quality"]) for x in high] == [(*expected, 875)]
        assert [x["type"] for x in r["regions"][:-1]] == [bam.SCRAPS.get(t.get("sc"), "Insert") for t in tags]
    only = bam.molecules(bam.read_bam(spark, f"{folder}/movie.scraps.bam"))
    assert {r["kind"] for r in only.select("kind").distinct().collect()} <= {"Adapter", "LQRegion"}
    with pytest.raises(ValueError):
        bam.read_pair(spark, "x.bam")


def test_gaps_overlaps_and_odd_rows(spark):
    rows = [(1, 10, 14, "Insert", "ACGT", None, None), (1, 18, 20, "Adapter", "GG", 900, "N"), (1, 19, 22, "Insert", "GCA", 800, "C"), (2, 0, 3, "LQRegion", None, 1, "N"), (None, 0, 1, "Insert", "A", 1, "N"), (3, 0, 4, "Insert", "ACGT", 1, "N"), (3, 4, 6, "LQRegion", "AC", 1, "N"), (3, 6, 8, "Insert", "GT", 1, "N")]
    df = spark.createDataFrame(rows, "hole int, start int, stop int, kind string, bases string, accuracy int, zmw_type string")
    found = {r["hole"]: r for r in holes.stitch_sources(df).collect()}
    assert set(found) == {1, 2, 3} and found[1]["bases"] == "ACGTNNNNGGCA" and found[1]["status"] == 1
    assert [tuple(x) for x in found[1]["regions"]] == [("Insert", 0, 4, 0), ("Adapter", 8, 10, 0), ("Insert", 9, 12, 0), ("HQRegion", 0, 12, 900)]
    assert [x["type"] for x in found[2]["regions"]] == ["LQRegion", "HQRegion"] and found[2]["regions"][1]["stop"] - found[2]["regions"][1]["start"] == 0
    assert [x["type"] for x in found[3]["regions"]] == ["Insert", "LQRegion", "Insert"]
    listed = holes.region_listing(holes.stitch_sources(df)).where("hole = 1").orderBy("region").collect()
    assert [r["type"] for r in listed] == ["Insert", "Adapter", "Insert", "HQRegion"]


def test_filter_and_write(spark, files, tmp_path):
    folder, parts = files
    lines = spark.createDataFrame([("cell/65531",), ("cell/65540/0_99999",), ("other/65550",), ("cell/x",), (None,), ("cell/65531",)], "value string")
    chosen = bam.white_list(lines, "cell")
    assert sorted((r["hole"], r["start"]) for r in chosen.where("start is not null").collect()) == [(65540, 0)]
    rows = bam.filter_molecules(bam.molecules(bam.read_bam(spark, f"{folder}/movie.scraps.bam")), chosen)
    made = bam.write_bam(rows.coalesce(2).sortWithinPartitions("place"), f"file://{tmp_path}/out")
    expected = sorted(p[0] for p in parts if p[4] and (p[0].split("/")[1] == "65531" or p[0].startswith("cell/65540/0_")))
    assert sum(r["records"] for r in made.collect()) == len(expected)
    assert sorted(r["name"] for r in bam.read_bam(spark, str(tmp_path / "out")).collect()) == expected


def test_bases_are_packed_at_once():
    for text in ("", "A", bam.BASES, "ACGTN" * 1001):
        assert bam.decode(bam.encode("n", text, []))[6] == text
    for text in ("E", "a", " A", "AF"):
        with pytest.raises(ValueError, match="no code"):
            bam.encode("n", text, [])
