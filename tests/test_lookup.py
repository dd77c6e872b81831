import glob
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from quillon.operators import lookup as J
from quillon.plans import ORACLES, PLANS


def test_disambiguated_by_value_is_the_general_form(spark):
    left = spark.createDataFrame([(i, i % 9 if i % 11 else None, i % 5 if i % 7 else None) for i in range(300)], "rid long, k long, want int")
    right = spark.createDataFrame([(1 if i % 2 else i % 8, i, i % 40 % 6) for i in range(60)] + [(8, 900, 1)], "k long, part long, mark int")
    want = {tuple(r) for r in J.disambiguated(left, right, "k", "rid", F.col("mark") == F.col("want")).select("rid", "status", "part", "mark").collect()}
    got = J.disambiguated_by_value(left, right, "k", "mark", "want").select("rid", "status", "part", "mark").collect()
    assert len(got) == 300 and {tuple(r) for r in got} == want and {r["status"] for r in got} == {"matched", "missing", "ambiguous"}


def test_lookup_reads_both_tables_whole(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        base.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    got = [tuple(r) for r in PLANS["mcq_lookup"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(base.execute(ORACLES["mcq_lookup"]).fetchall(), key=str)
    assert len(got) == base.execute("SELECT count(DISTINCT l_orderkey * 10000 + l_partkey % 10000) FROM lineitem").fetchone()[0]
    assert {s for _, s, _ in got} == {"matched", "missing", "ambiguous"}
