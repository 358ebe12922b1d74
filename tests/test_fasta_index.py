"""The index of FASTA files against reading them whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.sources import fasta_index, sequences
from tesserae.sources.ranges import shared_folder


def make(folder, seed=1):
    rng, out = random.Random(seed), []
    for f in range(3):
        records = [(f"r{f}_{k}{rng.choice(['', ' more > words'])}", "\n".join("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4)))) for k in range(60)]
        end = "\n" if f else ""
        (folder / f"{f}.fa").write_text((["", "text before\nthe first\n", " \n "][f]) + "\n".join(f">{h}\n{t}" for h, t in records) + end)
        out += records
    (folder / "3.fa").write_text("")
    return out


@pytest.mark.parametrize("block", [1, 17, 400, 1 << 20])
def test_same_records_whatever_the_ranges(spark, tmp_path, block):
    expected = make(tmp_path)
    index = fasta_index.index_fasta(spark, str(tmp_path), block)
    found = index.orderBy("seq_id").collect()
    assert [r["seq_id"] for r in found] == list(range(180))
    assert [r["name"] for r in found] == [h.split(" ")[0] for h, _ in expected]
    read = fasta_index.read_records(index).orderBy("seq_id").collect()
    assert [(r["header"], r["raw"].strip("\n")) for r in read] == [(h, t.strip("\n")) for h, t in expected]
    whole = {r["header"]: r["raw"].strip("\n") for r in sequences.read_fasta(spark, str(tmp_path)).collect()}
    assert whole == {r["header"]: r["raw"].strip("\n") for r in read}


def test_export_import_and_some_records(spark, tmp_path):
    make(tmp_path / "d" if (tmp_path / "d").mkdir() is None else tmp_path)
    fasta_index.write_index(fasta_index.index_fasta(spark, str(tmp_path / "d"), 100), str(tmp_path / "index"))
    index = fasta_index.read_index(spark, str(tmp_path / "index"))
    some = fasta_index.read_records(index.where(F.col("seq_id").isin(5, 100))).orderBy("seq_id").collect()
    assert [r["seq_id"] for r in some] == [5, 100] and some[0]["header"].startswith("r0_5")
    assert fasta_index.read_records(index.where("name = 'r2_59'")).first()["header"].startswith("r2_59")
    with open(tmp_path / "d" / "1.fa", "a") as f:
        f.write(">new\nA\n")
    with pytest.raises(ValueError, match="changed"):
        fasta_index.read_index(spark, str(tmp_path / "index"))
    assert fasta_index.read_index(spark, str(tmp_path / "index"), check=False).count() == 180


def test_only_the_ranges_are_read(tmp_path):
    import pyarrow as pa

    place = tmp_path / "big.fa"
    place.write_text(">a\nAAAA\n>b\nCC\n>c\nGGGG\n")
    batch = pa.RecordBatch.from_pydict({"file": [f"file:{place}"], "offset": [8], "length": [6], "seq_id": [1]})
    (out,) = fasta_index._read(iter([batch]))
    assert out.to_pylist() == [{"seq_id": 1, "header": "b", "raw": "CC"}]


def test_no_shared_folder_on_a_drivers_disk():
    class Conf:
        def get(self, name, default="?"):
            return default if name == "spark.checkpoint.dir" else "file:/warehouse"

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        shared_folder(Spark(), "x")
