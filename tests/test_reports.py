"""Reports and their guards, heat maps, packed operations, cycles, best subreads, mirrored matrices and streams."""

from __future__ import annotations

import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import normalize
from tesserae.functions import sequence as seq
from tesserae.operators import aggregates, dispatch, holes, search, table_function
from tesserae.operators.kernels import Kernel
from tesserae.sources import heatmap, sinks
from tesserae.sources.profiles import D, I, M, Profile, simple_profile
from tesserae.streaming import search as streaming

PROFILE = simple_profile("ACG", "ACGT", cutoff=4)
CIRCLE = simple_profile("CAG", "ACGT", match=5, mismatch=-5, gap=-3, circular=True)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))) for i in range(20)] + [(90, None), (91, "")]
    return spark.createDataFrame(data, "seq_id long, raw string"), dict(data)


def test_guards(rows):
    pattern = Profile(type="PATTERN", pattern="A-x-C.")
    for output, profile, options in (("histogram", PROFILE, {"on_cycles": True}), ("density", pattern, {}), ("data", pattern, {}), ("png", pattern, {}), ("pdf", PROFILE, {}), ("hits", PROFILE, {"on_cycles": True, "cycle_range": (1, 2)})):
        with pytest.raises(ValueError):
            dispatch.guard(output, profile, **options)
    dispatch.guard("histogram", PROFILE, (1, 5), True)
    with pytest.raises(ValueError, match="ranges"):
        dispatch.report(rows[0], PROFILE, "density", score_range=(0, 9))


def test_reports(rows):
    df, texts = rows
    kernel = Kernel(CIRCLE)
    best = [kernel.hits(t, -(1 << 30), 1)[0] for t in texts.values() if t]
    found = {r["bin"]: r["n"] for r in dispatch.report(df, CIRCLE, "histogram", score_range=(-5, 60)).collect()}
    assert found == {b: sum(h.score == b for h in best) for b in range(-5, 61)}
    found = {r["bin"]: r["n"] for r in dispatch.report(df, CIRCLE, "histogram", score_range=(-5, 60), cycle_range=(2, 9)).collect()}
    assert found == {b: sum(h.score == b and 2 <= h.cycles <= 9 for h in best) for b in range(-5, 61)}
    found = {r["bin"]: r["n"] for r in dispatch.report(df, CIRCLE, "histogram", on_cycles=True, cycle_range=(1, 6), clip=(0, 0)).collect()}
    inside = [h for h, t in zip(best, [t for t in texts.values() if t], strict=True) if h.seq_begin > 0 and h.seq_end < len(t)]
    assert found == {b: sum(h.cycles == b for h in inside) for b in range(1, 7)}
    found = {(r["score"], r["cycles"]): r["n"] for r in dispatch.report(df, CIRCLE, "density", score_range=(0, 40), cycle_range=(1, 5)).collect()}
    assert found == {(s, c): sum((h.score, h.cycles) == (s, c) for h in best) for s in range(41) for c in range(1, 6)}
    assert dispatch.report(df, PROFILE, "hits").count() == search.search(df, [PROFILE]).count()
    assert dispatch.report(df, PROFILE, "data").count() == sum(4 * (len(t or "") + 1) for t in texts.values())


def pixels_of(data):
    """Palette indexes of an image without filters."""
    at, parts = 8, {}
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        at += 12 + n
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    assert not lines[:, 0].any() and len(parts[b"PLTE"]) == 768
    return lines[:, 1:]


def test_tiles_are_the_plain_image(rows):
    df, texts = rows
    kernel = Kernel(PROFILE)
    found = {}
    for r in dispatch.report(df.where("seq_id in (3, 5, 91)"), PROFILE, "png", levels=3, side=8, floor=-20).collect():
        found.setdefault((r["seq_id"], r["zoom"]), {})[r["tile_y"], r["tile_x"]] = pixels_of(bytes(r["png"]))
    assert {k for k, _ in found} == {3, 5, 91}
    for key in (3, 5):
        plain = np.maximum(kernel.matrix(kernel.encode(texts[key]))[0][:, :, 2].astype(np.int64), -20)
        low, high = plain.min(), plain.max()
        for zoom in range(3):
            step = 1 << zoom
            image = np.array([[plain[y : y + step, x : x + step].max() for x in range(0, plain.shape[1], step)] for y in range(0, len(plain), step)])
            own = found[key, zoom]
            whole = np.block([[own[y, x] for x in range(1 + max(t[1] for t in own))] for y in range(1 + max(t[0] for t in own))])
            assert (whole == (image - low) * 255 // (high - low)).all()
    assert heatmap.palette().shape == (256, 3)


def test_packed_operations(spark):
    states = ["XMMMX", "XMMIMDDX", "XMM--MX", "X" + "MI" * 62 + "X", "X" + "MI" * 62 + "MX", "X" + "M" * 5000 + "X", "XMRMX", "XX", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "i int, s string").select("i", seq.packed_cigar(F.col("s")).alias("p")).withColumn("t", seq.cigar_text(F.col("p"))).orderBy("i").collect()
    assert got[0]["p"] == [0xA003] and got[1]["p"] == [0xA002, 0xB001, 0xA001, 0xC002] and got[2]["t"] == "2M2D1M"
    assert len(got[3]["p"]) == 124 and got[4]["p"] is None and got[5]["t"] == "4095M905M"
    assert got[6]["p"] is None and got[7]["p"] == [] and got[8]["p"] is None


def test_cycles_without_insertion_wraps(rows):
    df, texts = rows
    found = {r["seq_id"]: r for r in search.best_cycles(df, CIRCLE).collect()}
    kernel, wraps = Kernel(CIRCLE), 0
    for key, text in texts.items():
        if not text:
            assert key not in found
            continue
        h = kernel.hits(text, -(1 << 30), 1)[0]
        path = h.states[::-1]  # from the end; after an R comes the move that wrapped
        own, at = 0, h.aligned[::-1]
        letters = iter(at)
        for i, c in enumerate(path[1:-1]):
            if c == "R":
                own += 1
            else:
                next(letters, None)
        r = found[key]
        assert (r["score"], r["begin"], r["end"]) == (h.score, h.row_begin, h.row_end)
        assert 1 <= r["cycles"] <= h.cycles == own + 1
        wraps += h.cycles - r["cycles"]
    # with free insertions at the border only, every wrap is one
    free = simple_profile("CAG", "ACGT", match=5, mismatch=-9, gap=0, circular=True)
    text = "CAGTTCAGTTCAG"
    df2 = df.sparkSession.createDataFrame([(1, text)], "seq_id long, raw string")
    assert search.best_cycles(df2, free).first()["cycles"] <= Kernel(free).hits(text, -(1 << 30), 1)[0].cycles


def test_best_subreads_and_histograms(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 9, 3), (1, 2, 9, 4), (2, 0, 7, 2), (3, 4, 30, 1)], "hole int, region int, score int, cycles int")
    best = {(r["hole"], r["region"]) for r in holes.best_subread(df).collect()}
    assert best == {(1, 1), (2, 0), (3, 4)}
    assert {r["bin"]: r["n"] for r in dispatch.zmw_histogram(df, 6, 10).collect()} == {6: 0, 7: 1, 8: 0, 9: 1, 10: 0}
    assert {r["bin"]: r["n"] for r in dispatch.zmw_histogram(df, 6, 10, cycles=F.col("cycles"), cycle_range=(3, 9)).collect()} == {6: 0, 7: 0, 8: 0, 9: 1, 10: 0}
    assert {r["bin"]: r["n"] for r in aggregates.histogram_with_cycles(df, F.col("score"), F.col("cycles"), 5, 9, (1, 3)).collect()} == {5: 1, 6: 0, 7: 1, 8: 0, 9: 1}


def test_matrix_and_its_mirror(spark):
    text = "ACGTA"
    df, back = (spark.createDataFrame([(1, t)], "seq_id long, raw string") for t in (text, text[::-1]))
    mirror = simple_profile("GCA", "ACGT", cutoff=4)
    a, b = Kernel(PROFILE).matrix(Kernel(PROFILE).encode(text))[0], Kernel(mirror).matrix(Kernel(mirror).encode(text[::-1]))[0]
    for r in aggregates.matrix_sum(search.cell_matrix(df, PROFILE), search.cell_matrix(back, mirror), 3).collect():
        y, x = r["seq"], r["prf"]
        assert (r["match"], r["insertion"], r["deletion"]) == tuple(int(a[y, x, s]) + int(b[5 - y, 3 - x, s]) for s in (2, 3, 0))


def test_running_totals_of_texts_and_structs(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([None, "", "x", "xé"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(9)), i, rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, t string, i int, n long").withColumn("o", F.struct("t", "i"))
    assert df.select(aggregates.range_bucket(df, "o").alias("b")).distinct().count() > 50
    found = {r["i"]: r["before"] for r in aggregates.running_total(df, "g", "o", "n", "before").collect()}
    order = sorted(data, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2]))
    for i, r in enumerate(order):
        assert found[r[2]] == sum(x[3] for x in order[:i] if x[0] == r[0])
    text = df.select("t", "n").where("t is not null").groupBy("t").agg(F.sum("n").alias("n"))
    total = {r["t"]: r["before"] for r in aggregates.running_total(text, None, "t", "n", "before").collect()}
    sums = sorted((r["t"].encode(), r["n"]) for r in text.collect())
    assert all(total[t.decode()] == sum(n for u, n in sums if u < t) for t, _ in sums)


def test_codon_blocks(spark):
    profile = simple_profile("MKLV", "ACDEFGHIKLMNPQRSTVWY")
    row = [("s1 text", 9, 0.5, 2, -1, 3, 8, 20, "KmL-V")]
    df = spark.createDataFrame(row, "header string, score int, norm_score float, ipmb int, ipme int, row_begin int, row_end int, seq_len int, aligned string")
    text = sinks.lines(df, profile, "codon_blocks", width=10).first()["text"]
    head = "ID\t1\nIR\tMKLV\nIS\ts1\nSR\t9\nSN\t0.500000\nCB\t2 4 4\nCS\t3 8 20\n**"
    assert text.startswith(head + "\nEX\t<K>   <L>\nAS\tMMMIIIMMM\n")
    blocks = text[len(head) :].removesuffix("**\n//").strip("\n").split("\n\n")
    assert [b.split("\n")[1] for b in blocks] == ["AS\tMMMIIIMMM", "AS\tDDDMMM"]
    assert [b.split("\n")[2] for b in blocks] == ["SA\t<K><m><L>", "SA\t<-><V>"] and blocks[0].split("\n")[3][6:9] == "atg"


def test_highlighted_cycles(spark):
    df = spark.createDataFrame([(1, "TTCAGCAGTT")], "seq_id long, raw string")
    hit = search.search(df, [CIRCLE], cutoff=20, key="seq_id").withColumn("header", F.lit("h")).withColumn("seq", F.lit("TTCAGCAGTT"))
    text = hit.select(sinks.highlighted_cycles(CIRCLE, F.col("seq")).alias("t")).first()["t"]
    head, body = text.split("\n")
    assert head.startswith(">h direction=>, raw_score=30 ") and head.endswith("cycle=1")
    assert body == "TT" + sinks.RED + "\x1b[4mCAG" + sinks.TURN + "CAG" + sinks.PLAIN + "TT"


def test_counts_as_a_file(spark, tmp_path):
    df = spark.createDataFrame([(2, 5), (1, 7), (10, 0)], "bin int, n long")
    sinks.write_counts(df, str(tmp_path / "h"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["1\t7", "2\t5", "10\t0"]


def wait(query):
    query.processAllAvailable()
    query.stop()


def test_stream_of_hits_to_a_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">r1\nTTACGTT\n>r2\nGGGG\n")
    from tesserae.sources.sequences import stream_fasta

    seen = []
    hits = streaming.stream_search(stream_fasta(spark, str(tmp_path / "in")), [PROFILE])
    query = streaming.to_sink(hits, lambda df, n: seen.extend((n, r["header"], r["score"]) for r in df.collect()), str(tmp_path / "ck")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.fa").write_text(">r3\nTACGT\n")
    time.sleep(0.1)
    wait(query)
    assert {(h, s) for _, h, s in seen} == {("r1", 9), ("r3", 9)} and len({n for n, _, _ in seen}) == 2


def test_windowed_counts_with_late_rows(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    part = lambda name, rows: (folder / name).write_text("\n".join(rows) + "\n")
    part("1.csv", ["2024-01-01 00:01:00,a,1.5", "2024-01-01 00:09:00,a,2.5", "2024-01-01 00:11:00,b,1.0"])
    events = spark.readStream.schema("ts timestamp, event_type string, value double").csv(str(folder))
    query = streaming.windowed_counts(events, "10 minutes", "1 hour").writeStream.format("memory").queryName("counted").outputMode("update").start()
    query.processAllAvailable()
    part("2.csv", ["2024-01-01 00:02:00,a,1.0", "2024-01-01 03:00:00,b,1.0"])
    query.processAllAvailable()
    part("3.csv", ["2024-01-01 00:03:00,a,100.0"])  # later than the watermark allows
    wait(query)
    last = {}
    for r in spark.table("counted").collect():
        key = (str(r["start"]), r["event_type"])
        last[key] = max(last.get(key, (0, 0)), (r["n"], r["total"]))
    assert last[("2024-01-01 00:00:00", "a")] == (3, 5.0) and last[("2024-01-01 00:10:00", "b")] == (1, 1.0)


@pytest.mark.parametrize("profile", [PROFILE, CIRCLE])
def test_matrices_of_many_sequences_side_by_side(rows, profile):
    """Rows, extremes, pixels and mirrored sums made beside the cells are those made of a table of cells."""
    df, _ = rows
    mirror = simple_profile("GAC", "ACGT", match=4, mismatch=-2, gap=-2, circular=profile.circular) if profile.length == 3 else profile
    cells = search.cell_matrix(df, profile)
    same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))
    kernel, own = Kernel(profile), {}
    for r in cells.collect():
        own.setdefault(r["seq_id"], {})[r["seq"], r["prf"]] = (r["match"], r["insertion"], r["deletion"])
    for r in df.collect():
        scores, _, _ = kernel.matrix(kernel.encode(r["raw"] or ""))
        assert own[r["seq_id"]] == {(i, j): tuple(int(c[s]) for s in (M, I, D)) for i, line in enumerate(scores) for j, c in enumerate(line)}
    for state in ("match", "insertion", "deletion"):
        assert same(search.matrix_rows(df, profile, state), sinks.rows_of(cells, state))
    assert same(search.matrix_extrema(df, profile), aggregates.matrix_extrema(cells))
    assert same(search.matrix_pixels(df, profile, 4, -5), heatmap.pixels(cells, F.greatest("match", F.lit(-5)), 4).withColumnRenamed("_key", "seq_id"))
    back = search.cell_matrix(df.select("seq_id", F.reverse("raw").alias("raw")), mirror)
    assert same(search.mirror_matrix(df, profile, mirror), aggregates.matrix_sum(cells, back, profile.length))
    assert "Exchange" not in search.matrix_rows(df, profile)._jdf.queryExecution().executedPlan().toString()


def test_mirrored_profiles_of_other_length_are_refused(rows):
    with pytest.raises(ValueError, match="length"):
        search.mirror_matrix(rows[0], PROFILE, simple_profile("ACGTACGTAC", "ACGT"))


def test_table_function_on_a_table(spark, rows):
    """Many rows at once give what each gives alone, whatever the key's type."""
    df, texts = rows
    table_function.register(spark, [PROFILE, CIRCLE], "alone")
    table_function.register_table(spark, [PROFILE, CIRCLE], "together")
    for p in (0, 1):
        for key in ("seq_id", "cast(seq_id AS string) AS seq_id"):
            own = df.selectExpr(key, "raw")
            a = spark.sql(f"SELECT s.seq_id, h.* FROM {{rows}} s, LATERAL alone(s.raw, {p}) h", rows=own)
            b = spark.sql(f"SELECT * FROM together(TABLE({{rows}}), {p})", rows=own)
            assert a.schema == b.schema and a.count() > 5
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_average_of_a_text_makes_no_array(spark):
    texts = ["", "A", "ZZZ", "HELLOWORLD", "AB" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    letters, weights = "ABCDEFGHIJKLMNOPQRSTUVWXY", [7, *range(1, 26)]
    plain = normalize.average_score(seq.encode(F.col("t"), letters), weights)
    got = df.select("t", plain.alias("a"), normalize.average_of_text(F.col("t"), letters, weights).alias("b"))
    assert all(r["a"] == r["b"] for r in got.where("t is not null").collect())
    assert got.where("t is null").first()["b"] is None
    assert "transform(" not in got.select("b")._jdf.queryExecution().executedPlan().toString()
