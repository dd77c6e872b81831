import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import frames as B


@pytest.fixture
def six(spark):
    return spark.createDataFrame([(i, i + 1, c) for i, c in enumerate("abcdef")], "_pos long, obs int, labels string")


def column(df, name):
    return [r[name] for r in df.orderBy("_pos").collect()]


def test_reorder(spark, six):
    p = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "new_pos long, old_pos long")
    out = B.reorder(six, p)
    assert column(out, "obs") == [4, 5, 3, 1, 2, 6]
    assert column(B.reorder(out, B.inverse(p)), "obs") == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize(("interleave", "want"), [(True, [1, 1, 2, 2]), (False, [1, 2, 1, 2])])
def test_repeat(spark, interleave, want):
    df = spark.createDataFrame([(0, 1), (1, 2)], "_pos long, obs int")
    assert column(B.repeat(df, 2, interleave, 2), "obs") == want


def test_pad_and_unpad(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "_pos long, obs int")
    assert column(B.pad(df, 2, 3), "obs") == [1, 2, 3, 1]
    assert column(B.pad(df, 3, 3), "obs") == [1, 2, 3]
    assert column(B.pad(df, 8, 3), "obs") == [1, 2, 3, 1, 2, 3, 1, 2]
    assert column(B.unpad(B.pad(df, 8, 3), 3), "obs") == [1, 2, 3]


def test_chunk_and_split(six):
    with pytest.raises(ValueError):
        B.chunk(six, 5, 6)
    assert column(B.chunk(six, 2, 6), "chunk") == [0, 0, 0, 1, 1, 1]
    assert column(B.split(six, 4), "part") == [0, 0, 0, 0, 1, 1]


def test_union_needs_equal_columns(spark, six):
    same = six.select("_pos", "obs", F.lit(1).alias("more"))
    assert B.union_columns(six, same).columns == ["_pos", "obs", "labels", "more"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        B.union_columns(six, same.withColumn("obs", F.col("obs") + 1)).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        B.union_columns(six, same.where("_pos < 5")).collect()


def test_slices_follow_python(six):
    values = [1, 2, 3, 4, 5, 6]
    for start, stop, step in [(None, None, 1), (1, 4, 1), (-2, None, 1), (None, None, -1), (5, 0, -2), (4, 2, 1), (0, 100, 3)]:
        assert column(B.cut(six, start, stop, step, 6), "obs") == values[start:stop:step]


def test_take_repeats_and_orders(six):
    assert column(B.take(six, [4, 0, 0]), "labels") == ["e", "a", "a"]


def test_select_pop_rename(six):
    frame = B.Frame(six, {"info": 1, "other": 2})
    assert frame.select(["obs", "absent"], ["info"]).meta == {"info": 1}
    chosen, rest = frame.pop(["obs"])
    assert chosen.df.columns == ["_pos", "obs"] and rest.df.columns == ["_pos", "labels"]
    with pytest.raises(KeyError):
        frame.pop(["absent"])
    with pytest.raises(ValueError):
        frame.rename(["obs"], [])
    assert len(frame) == 6 and frame.item(2).first()["labels"] == "c"


def test_fold_concat_positions(spark, six):
    assert column(B.fold(six, 3, 6, "obs"), "obs") == [[1, 2], [3, 4], [5, 6]]
    assert column(B.concat([six, six]), "obs") == [1, 2, 3, 4, 5, 6] * 2
    shuffled = six.drop("_pos").orderBy(F.desc("labels"))
    assert column(B.with_positions(shuffled, "labels"), "labels") == list("abcdef")


def test_flat_names():
    nested = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert B.flatten(nested) == {"a/b": 1, "a/c/d": 2, "e": 3}
    assert B.unflatten(B.flatten(nested)) == nested
