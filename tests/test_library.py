from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import normalize, pattern
from tesserae.functions import sequence as seq
from tesserae.operators import aggregates, holes, native, search
from tesserae.operators.kernels import MAP_SCORES, Kernel
from tesserae.sources import sequences, sinks
from tesserae.sources.profiles import simple_profile
from tesserae.streaming.search import running_histogram, stream_search


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_transforms(spark):
    cases = [
        (seq.clean, "ac-g T1\né", "ACGT"),
        (seq.clean_keep_case, "ac-g T1\n", "acgT"),
        (seq.reverse_complement, "ACGTN", "NACGT"),
        (seq.reverse_complement_strict, "ACGTN", "?ACGT"),
        (lambda c: seq.encode(c, "ACGT"), "ACXT", [1, 2, 0, 4]),
        (lambda c: seq.encode(c, "ACGT"), "", []),
        (seq.identifier, "a|b|c d e", "a|b|c"),
        (seq.short_identifier, "a|b|c d e", "c"),
        (lambda c: seq.wrap(c, 3), "ABCDEFG", "ABC\nDEF\nG"),
        (lambda c: seq.wrap(c, 3), "", ""),
        (seq.translate_frame, "ATGTAAGGNATNNGGA", "M*GXX"),
        (lambda c: seq.translate_frame(c, complement=True), "TACATTCCNA", "M*G"),
        (lambda c: seq.translate_frame(c, complement=True, backwards=True), "NCCTTACAT", "M*G"),
        (lambda c: seq.translate_frame(c, 1), "AATG", "M"),
        (seq.translate_frame, "AT", ""),
        (seq.interleaved_translation, "ATGG", "MW"),
        (seq.amino_to_codons, "MX", "ATGNNN"),
        (seq.run_lengths, "XMMMI-X", "X1M3I1-1X1"),
    ]
    for column, value, expected in cases:
        assert one(spark, column, value) == expected


def test_patterns(spark):
    table = {"C-x(2)-C": "C.{2}C", "[AC]-x-V-x(4)-{ED}": "[AC].V.{4}[^ED]", "A-x-T>": "A.T$", "[<AC]-G": "(?:^|[AC])G", "F-[GSTV>]": "F(?:[GSTV]|$)", "<M-A.": "<MA"}
    assert {p: pattern.to_regex(p) for p in table} == table
    assert one(spark, lambda c: pattern.count(c, "C{1,3}A{1,3}G{1,3}"), "CAGCAGCCAAG") == 3
    assert one(spark, lambda c: pattern.cycles(c, "CAG", 3), "CAGTCAGCAGT") == 2
    assert one(spark, lambda c: pattern.cycles(c, "CAG", 3), "") == 0


def test_normalisation_inverts(spark):
    r = [20.0, -0.001, 0.25, 11.0, 7.0]
    df = spark.range(1, 400, 7).withColumn("n", F.lit(300))
    norm = normalize.to_normalized(F.col("id"), normalize.ZSCORE, r, F.col("n"), strict=True)
    assert df.where(normalize.to_raw(norm, normalize.ZSCORE, r, F.col("n")) != F.col("id")).count() == 0
    assert df.where(normalize.to_raw(normalize.to_normalized(F.col("id"), "LINEAR", [0.5, 0.25]), "LINEAR", [0.5, 0.25]) != F.col("id")).count() == 0


def test_native_scores_equal_the_kernel(spark):
    rng = random.Random(8)
    profile = simple_profile("VCP", "CEPSV", match=4, mismatch=-2, gap=-1)
    kernel = Kernel(profile)
    rows = [(i, "".join(rng.choice("CEPSVX") for _ in range(rng.randint(0, 15)))) for i in range(60)]
    df = spark.createDataFrame(rows, "seq_id int, raw string")
    got = {r[0]: r[1] for r in df.select("seq_id", native.best_score(F.col("raw"), profile)).collect()}
    expected = {i: int(kernel.best_scores([kernel.encode(s)])[0]) if s else None for i, s in rows}
    assert got == expected
    fast = {r["seq_id"]: r["score"] for r in search.best_scores(df, [profile]).collect()}
    assert all(fast[i] == v for i, v in expected.items() if v is not None)
    assert search.heuristic_scores(df, profile).join(df.select("seq_id", native.heuristic(F.col("raw"), profile).alias("h")), "seq_id").where("heuristic <> h").count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "s1 one", "ttACGTTTACGTaa"), (2, "s2", "AACGTAA"), (3, "s3", None), (4, "s4", ""), (5, "s5", "12 34")]
    return spark.createDataFrame(rows, "seq_id long, header string, raw string")


def test_search_filters_and_strands(table):
    p = simple_profile("ACGT", "ACGT", cutoff=12)
    hits = search.search(table, [p]).orderBy("seq_id", "rank").collect()
    assert [(h["seq_id"], h["rank"], h["seq_begin"], h["score"], h["aligned"]) for h in hits] == [(1, 1, 8, 12, "ACGT"), (1, 2, 2, 12, "ACGT"), (2, 1, 1, 12, "ACGT")]
    count = lambda **o: search.search(table, [p], **o).count()
    assert count(top=1) == 2
    assert count(both_strands=True) == 6
    assert {h["orientation"] for h in search.search(table, [p], best_strand=True).collect()} == {1}
    assert count(score_range=(12, 12), clip=(3, 0)) == 1
    assert count(score_range=(12, 12), clip=(3, 0), invert=True) == 2
    assert count(score_range=(13, 20)) == 0


def test_extracts(table):
    p = simple_profile("ACGT", "ACGT", cutoff=12)
    hits = search.search(table, [p])
    get = lambda what: sorted((r["seq_id"], r["part"], r["text"]) for r in search.extract(table, hits, what).collect())
    assert get("source") == [(1, 1, "TTACGTTTACGTAA"), (2, 1, "AACGTAA")]
    assert get("after") == [(1, 1, "AA"), (1, 2, "TTACGTAA"), (2, 1, "AA")]
    assert get("before") == [(1, 1, "TTACGTT"), (1, 2, "T"), (2, 1, "")]
    assert get("between") == [(1, 1, "TT"), (1, 2, "TT"), (1, 3, "AA"), (2, 1, "A"), (2, 2, "AA")]


def test_formats(table):
    p = simple_profile("ACGT", "ACGT", cutoff=12)
    hits = search.with_norm(search.search(table, [p], top=1).join(table.select("seq_id", "header"), "seq_id"), p).where("seq_id = 1")
    text = {n: sinks.lines(hits, p, n).first()["text"] for n in sinks.FORMATS}
    assert text["default"] == "  1.200      12 pos.       8 -      12 > s1 one ACGT"
    assert text["tsv"] == "XX00000\ts1\t8\t12\t12\t1.200000\tACGT"
    assert text["one_line"] == "ACGT\ts1\t+\t12\t1.200000\t0\t4\t4\t8\t11\t14"
    assert text["fasta"] == ">s1 one\nACGT"
    assert text["extended"].startswith(">s1/8-12 motif=XX00000|ACGT norm_score=1.200 raw_score=12 level_tag=0 ")
    cells = search.cell_matrix(table.where("seq_id = 2"), p)
    assert cells.count() == 8 * 5
    assert sinks.rows_of(cells, "match").count() == 8 and sinks.rows_of(cells, "match", by="prf").count() == 5


def test_classify_and_map(table):
    p = simple_profile("ACGT", "ACGT", cutoff=12)
    found = search.classify(search.search(table, [p]), [simple_profile("TTTT", "ACGT"), simple_profile("ACGT", "ACGT"), simple_profile("ACGT", "ACGT")])
    assert {(r["class_id"], r["class_score"]) for r in found.collect()} == {(1, 12)}
    places = search.map_tags(table, [("t", "ACGT"), ("none", "")]).collect()
    assert {(r["seq_id"], r["begin"], r["end"], r["score"]) for r in places} == {(1, 2, 5, 16), (2, 1, 4, 16)}
    assert sequences.load_scores(sequences.dump_scores()) == MAP_SCORES
    with pytest.raises(ValueError, match="unknown parts"):
        sequences.load_scores('{"Other": {}}')


def test_fasta_batch_stream_and_sniff(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>s1 x\nACGT\nac\n>s2\n\n>s3 last\nAC-GT")
    (tmp_path / "b.fa").write_text(">only\r\nACGT\r\n")
    rows = sequences.read_fasta(spark, str(tmp_path)).select("header", seq.clean(F.col("raw")).alias("s")).collect()
    assert sorted(map(tuple, rows)) == [("only", "ACGT"), ("s1 x", "ACGTAC"), ("s2", ""), ("s3 last", "ACGT")]
    assert {r["format"] for r in sequences.sniff(spark, str(tmp_path / "b.fa")).collect()} == {"fasta"}
    many = tmp_path / "many"
    many.mkdir()
    for k in range(12):  # small files share a partition
        (many / f"{k}.fa").write_text(f"junk before {k}\nmore\n>r{k} a\nAC\n>s{k}\nGT\n")
    found = sequences.read_fasta(spark.newSession(), str(many)).select("header", seq.clean(F.col("raw")).alias("s")).collect()
    assert sorted(map(tuple, found)) == sorted([(f"r{k} a", "AC") for k in range(12)] + [(f"s{k}", "GT") for k in range(12)])
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(3 << 30)
    assert [r["format"] for r in sequences.sniff(spark, str(tmp_path / "sparse.bin")).collect()] == ["unknown"]
    (tmp_path / "c.bin").write_bytes(b"\x89HDF\r\n")
    assert sequences.sniff(spark, str(tmp_path / "c.bin")).first()["format"] == "hdf5"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.fa").write_text(">one\nTTACGTTT\n>two\nCCCC\n")
    stream = stream_search(sequences.stream_fasta(spark, str(folder)), [simple_profile("ACGT", "ACGT", cutoff=12)])
    query = stream.writeStream.format("memory").queryName("hits_found").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["header"], r["score"]) for r in spark.table("hits_found").collect()] == [("one", 12)]


def test_running_histogram(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") % 4).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "p"))
    query = running_histogram(stream, F.col("v"), 1, 2).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    query.processAllAvailable()
    query.stop()
    assert {r["bin"]: r["n"] for r in spark.table("bins").collect()} == {1: 3, 2: 2}


def test_holes(spark):
    rows = [
        (1, 0, 0, 0, "ACGTACGTAC", [("Insert", 0, 4, 0), ("Insert", 6, 10, 0), ("HQRegion", 2, 8, 800)]),
        (2, 0, 0, 0, "ACGT", [("Insert", 0, 4, 0), ("HQRegion", 0, 0, 0)]),
        (3, 0, 0, 1, "ACGT", [("Insert", 0, 4, 0)]),
    ]
    zmw = spark.createDataFrame(rows, holes.ZMW)
    clipped = {r["hole"]: r for r in holes.clip_to_high_quality(zmw).collect()}
    assert [tuple(x)[:3] for x in clipped[1]["regions"]] == [("Insert", 2, 4), ("Insert", 6, 8), ("HQRegion", 2, 8)] and clipped[1]["hq_length"] == 6
    assert clipped[2]["regions"][0]["type"] == "Useless" and clipped[3]["regions"][0]["type"] == "Insert"
    pick = lambda **o: sorted(r["hole"] for r in holes.select(zmw, **o).collect())
    assert pick() == [1] and pick(invalid="only") == [2] and pick(invalid="keep", sequencing_only=False) == [1, 2, 3]
    assert pick(min_quality=801) == [] and pick(number=2, invalid="keep") == [2]
    assert pick(white_list=zmw.where("hole = 2")) == []
    assert [tuple(r) for r in holes.subreads(zmw).orderBy("hole", "region").collect()][:2] == [(1, 0, 0, 4, "ACGT"), (1, 1, 6, 10, "GTAC")]
    assert tuple(holes.summary(zmw).first()) == (3, 2, 1, 0, 1, 3, 2, 1, 1)
    reads = spark.createDataFrame([(1, 5, "B"), (1, 2, "A"), (2, 0, "C")], "hole int, start int, bases string")
    assert {r["hole"]: r["bases"] for r in holes.stitch(reads).collect()} == {1: "AB", 2: "C"}
    got = spark.createDataFrame([([2, 1, 3], [4, 2, 5])], "p array<int>, w array<int>").select(holes.pulses(F.col("p"), F.col("w")).alias("x")).first()["x"]
    assert [(f["start"], f["end"]) for f in got] == [(2, 6), (7, 9), (12, 17)]
    assert one(spark, lambda c: holes.decode_trace(c, [10, 20, 30], 5), [0, 2], "array<int>") == [5, 25]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 0), (2, 9, 1), (2, None, 0)], "g int, v int, t int")
    assert [tuple(r) for r in aggregates.histogram(df, F.col("v"), 4, 6).orderBy("bin").collect()] == [(4, 0), (5, 2), (6, 0)]
    assert aggregates.missed(df, F.col("v"), 4, 6).first()["missed"] == 2
    assert sorted(map(tuple, aggregates.density(df, F.col("v"), F.col("t"), (5, 6), (0, 2)).collect())) == [(5, 0, 1), (5, 1, 1)]
    assert [tuple(r) for r in aggregates.contingency(df.where("v is not null"), F.col("v"), F.col("t"), [6]).collect()] == [(6, 1, 0, 1, 1)]
    assert sequences.random_sequences(spark, 3, 5, 2).where("length(raw) = 11").count() == 3


def test_entry_and_some_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_running_totals_in_buckets(spark):
    rng = random.Random(9)
    rows = [(k % 3 if k % 7 else None, k if k % 50 else None, rng.randint(0, 9)) for k in range(3000)]
    table = spark.createDataFrame(rows, "g long, o long, n long").where("o is not null")
    for group in (None, "g"):
        found = holes.running_offset(table, group, "o", "n").collect()
        seen: dict = {}
        for r in sorted(found, key=lambda r: r["o"]):
            key = r["g"] if group else 0
            assert r["offset"] == seen.get(key, 0)
            seen[key] = r["offset"] + r["n"]
        assert len(found) == table.count()
    assert holes.running_offset(table.limit(0), None, "o", "n").count() == 0
    own = [rng.randint(0, 500) for _ in range(2000)]
    r = aggregates.quartile_limit(spark.createDataFrame([(x,) for x in own], "v long"), F.col("v")).first()
    own.sort()
    assert r["q25"] == own[500] and r["q75"] == own[1500] and r["limit"] == max(x for x in own if x <= r["bound"])
