import itertools
import random

import pytest

from quillon.operators import balance as Q
from quillon.operators import sampling as L


def spread(lengths, piles):
    sums = [sum(lengths[i] for i in p) for p in piles]
    return max(sums) - min(sums)


def test_every_index_once_and_equal_sizes():
    random.seed(3)
    for _ in range(50):
        k = random.randint(1, 5)
        lengths = [random.randint(0, 50) for _ in range(k * random.randint(1, 6))]
        for equal in (False, True):
            piles = Q.differencing(lengths, k, equal)
            assert sorted(i for p in piles for i in p) == list(range(len(lengths))) and all(piles)
            if equal:
                assert len({len(p) for p in piles}) == 1


def test_close_to_the_best_two_way_split():
    random.seed(4)
    for _ in range(30):
        lengths = [random.randint(1, 30) for _ in range(8)]
        best = min(abs(sum(lengths) - 2 * sum(c)) for n in range(9) for c in itertools.combinations(lengths, n))
        assert spread(lengths, Q.differencing(lengths, 2)) <= best + max(lengths)


def test_known_case_and_errors():
    assert spread([8, 7, 6, 5, 4], Q.differencing([8, 7, 6, 5, 4], 2)) == 2
    with pytest.raises(ValueError):
        Q.differencing([1], 2)
    with pytest.raises(ValueError):
        Q.differencing([1, 2, 3], 2, equal_size=True)
    assert sorted(i for p in Q.greedy([3, 1, 2], 2) for i in p) == [0, 1, 2]


def test_micro_batches_hold_the_budget(spark):
    random.seed(5)
    df = spark.createDataFrame([(0, i, random.randint(40, 100)) for i in range(20)], "batch int, pos int, length long")
    out = Q.micro_batches(df, "batch", "pos", "length", 300)
    total = df.groupBy().sum("length").first()[0]
    assert out.count() == 20
    assert out.select("part").distinct().count() == -(-total // 300)
    sums = {r["part"]: r["s"] for r in out.selectExpr("part", "length * length as s").groupBy("part").agg({"s": "sum"}).withColumnRenamed("sum(s)", "s").collect()}
    assert [sums[k] for k in sorted(sums)] == sorted(sums.values(), reverse=True)


def test_apportion():
    assert L.apportion(10, [1, 1, 1]) == [3, 3, 4]
    assert sum(L.apportion(101, [2, 1, 0.5])) == 101
    with pytest.raises(ValueError):
        L.apportion(1, [])


def test_split_arithmetic(spark):
    """int(3022 * 0.7) groups train and the rest test, when every row is a group of its own."""
    df = spark.range(3022).withColumnRenamed("id", "g")
    counts = {r["split"]: r["count"] for r in L.split_by_group(df, "g", 1, (0.7, 0.0, 0.3)).groupBy("split").count().collect()}
    assert counts == {"train": 2115, "test": 907}


def test_fewshot_quota_without_filling_up(spark):
    """Labels that are short of their quota stay short."""
    sizes = {"a": 500, "b": 500, "c": 10}
    df = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, label string")
    counts = {r["label"]: r["count"] for r in L.fewshot_by_ratio(df, "label", "id", 1, 0.5).groupBy("label").count().collect()}
    assert counts["c"] == 10 and {counts["a"], counts["b"]} <= {168, 169}


def test_retention(spark):
    df = spark.createDataFrame([(s,) for s in (5, 10, 15, 20, 25)], "step int")
    assert {r[0] for r in L.retained(df, "step", 10, 2).collect()} == {10, 25}
