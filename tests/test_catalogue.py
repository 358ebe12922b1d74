"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.operators import search
from tesserae.plans import catalogue
from tesserae.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, list):
        return tuple(map(_cell, v))
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())


def test_whole_documents_against_the_scalar_kernel(spark):
    from tesserae.operators.kernels import Kernel
    from tesserae.plans.catalogue import WORDS, k1_best_documents

    from .test_kernels import scalar

    got = {(r["doc_id"], r["profile_id"]): r["score"] for r in k1_best_documents(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").orderBy("n_chars").limit(12).collect()
    for t in texts:
        for k, p in enumerate(WORDS):
            seq = Kernel(p).encode(t["text"]).tolist()
            cells = scalar(p, seq, "standard")
            assert got[t["doc_id"], k] == max(c[1] for row in cells[1:] for c in row[1:])


def test_best_cycles_counts_wraps_from_insertions(spark, tmp_path):
    """Texts whose best alignment wraps from an insertion; the smallest tables have none."""
    names = {"V": "view", "C": "click", "P": "purchase", "S": "signup", "E": "error"}
    texts = {1: "PPVCVCVCSVCPP", 2: "VCVCSVCVCVC", 3: "EVCVCVC", 4: "SSS"}
    rows = [(k * 100 + i, k, i, names[c]) for k, text in texts.items() for i, c in enumerate(text)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, second int, event_type string")
    events.select("event_id", "user_id", F.timestamp_seconds("second").alias("ts"), "event_type").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT user_id, score, cycles, \"begin\", \"end\" FROM ({ORACLES['best_cycles']})").fetchall()
    got = QUERIES["best_cycles"](spark, str(tmp_path)).select("user_id", "score", "cycles", "begin", "end")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plain = search.best_cycles(catalogue.symbols(spark, str(tmp_path)), catalogue.CYCLE, key="user_id").collect()
    assert sum(r["cycles"] for r in plain) < sum(w[2] for w in want)
