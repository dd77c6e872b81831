import collections
import re

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import frames as B
from quillon.operators import sampling as L
from quillon.plans import ORACLES, PLANS


@pytest.fixture(scope="module")
def hot(spark):
    """9000 rows, a third of them of one label, some without a label, keys repeated."""
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("l"), (F.col("id") % 7).cast("string")))
    return spark.range(9000).select((F.col("id") % 8000).alias("k"), label.alias("label"), F.lit("kept").alias("_n"))


def test_ranks_are_those_of_one_window(hot):
    drawn = L.draw(3, "x", "k")
    for by in ([], ["label"]):
        rows = L.ranked(hot, drawn, "k", by).select("label", "k", "_rank", "_total", L.draw(3, "x", "k").alias("d")).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["label"] if by else 0, []).append(r)
        assert sum(map(len, groups.values())) == 9000
        for own in groups.values():
            own.sort(key=lambda r: r["_rank"])
            assert [r["_rank"] for r in own] == list(range(1, len(own) + 1))
            assert {r["_total"] for r in own} == {len(own)}
            assert [(r["d"], r["k"]) for r in own] == sorted((r["d"], r["k"]) for r in own)


def test_a_plan_has_no_window_over_all_rows(hot):
    plan = L.ranked(hot, L.draw(3, "x", "k"), "k", ["label"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(label#\d+, \d+\)", plan)) == 1  # the one over counts
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("n", [0, 1, 50, 5000, 9000, 9001])
def test_samples_are_the_first_by_hash(hot, n):
    got = [r["k"] for r in L.sample(hot, "k", 5, "s", n).collect()]
    want = [r["k"] for r in hot.select("k", L.draw(5, "s", "k").alias("d")).orderBy("d", "k").limit(n).collect()]
    assert sorted(got) == sorted(want)


def test_short_labels_are_an_error_where_asked(hot):
    assert L.kshot(hot.where("label is not null"), "label", "k", 1, 5).groupBy("label").count().where("count <> 5").count() == 0
    assert L.kshot(hot.where("label is not null"), "label", "k", 1, 2000, strict=False).where("label = 'hot'").count() == 2000
    with pytest.raises(PySparkException):
        L.kshot(hot.where("label is not null"), "label", "k", 1, 2000).collect()


def test_empty_tables(hot):
    none = hot.where("false")
    assert L.ranked(none, L.draw(1, "x", "k"), "k", ["label"]).count() == 0
    assert L.sample(none, "k", 1, "s", 5).count() == L.split_by_group(none, "label", 1, (0.5, 0.2, 0.3)).count() == 0
    assert L.fewshot_by_ratio(none, "label", "k", 1, 0.5).count() == 0


def test_batches_of_an_epoch(spark):
    df = spark.range(103).select(F.col("id").alias(B.POS))
    rows = B.batches(df, 10, 3, 4, 103).collect()
    assert len(rows) == 300
    for e in range(3):
        own = [r for r in rows if r["epoch"] == e]
        assert len({r[B.POS] for r in own}) == 100
        assert sorted((r["batch"], r["place"]) for r in own) == [(b, p) for b in range(10) for p in range(10)]
    assert [r[B.POS] for r in rows if r["epoch"] == 0] != [r[B.POS] for r in rows if r["epoch"] == 1]


@pytest.mark.parametrize("rows", [0, 7, 2999, 3000, 6000])
def test_draws_with_replacement_are_those_of_the_sql(spark, tmp_path, rows):
    """As many suppliers as draws or more, too; some keys repeated or null."""
    key = F.when(F.col("id") % 50 == 3, F.lit(None)).otherwise(F.col("id") % 5000 + 1)
    spark.range(rows).select(key.alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = PLANS["mix_ratio_oversample"](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
        want = c.execute(ORACLES["mix_ratio_oversample"]).fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want) and len(want) == (3000 if rows else 0)
