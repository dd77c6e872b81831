"""Group-relative statistics over rollouts: every group statistic is a window over the group key, without a join back.

``score`` and ``uid`` name the score and the group. Standard deviations are of the sample unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _group(uid: str) -> Window:
    return Window.partitionBy(uid)


def require_groups(df: DataFrame, uid: str = "uid") -> DataFrame:
    """df, failing at run time where a group has one member only."""
    counted = df.withColumn("_members", F.count("*").over(_group(uid)))
    return counted.where(F.assert_true(F.col("_members") > 1, F.lit("a group needs two members at least")).isNull()).drop("_members")


def grpo(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """advantage: the score's distance from its group's mean, in group standard deviations (W-01, J-03)."""
    w = _group(uid)
    return require_groups(df, uid).withColumn("advantage", (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps))


def pass_at_k(df: DataFrame, uid: str = "uid", score: str = "score", order: str = "sid", eps: float = EPS, zero_rest: bool = False) -> DataFrame:
    """advantage (W-02): the best member gets its lead over the second in group deviations, the first one on ties; others keep their score, or 0."""
    w = _group(uid)
    by = w.orderBy(F.desc(score), F.asc(order))
    second = F.max(F.when(F.col("_rank") == 2, F.col(score))).over(w)
    ranked = require_groups(df, uid).withColumn("_rank", F.row_number().over(by))
    best = (F.col(score) - second) / (F.stddev_samp(score).over(w) + eps)
    return ranked.withColumn("advantage", F.when(F.col("_rank") == 1, best).otherwise(F.lit(0.0) if zero_rest else F.col(score))).drop("_rank")


def rloo(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """advantage (W-03): the score less the mean of the group's others."""
    w = _group(uid)
    others = (F.sum(score).over(w) - F.col(score)) / (F.count("*").over(w) - 1)
    return require_groups(df, uid).withColumn("advantage", F.col(score) - others)


def filter_groups(df: DataFrame, low: float, high: float, uid: str = "uid", score: str = "score") -> DataFrame:
    """Members of groups whose mean score lies strictly between the bounds (C-09)."""
    return df.withColumn("_mean", F.avg(score).over(_group(uid))).where((F.col("_mean") > low) & (F.col("_mean") < high)).drop("_mean")


def all_wrong(df: DataFrame, uid: str = "uid", correct: str = "correct") -> DataFrame:
    """Groups without a correct member: uid and size (C-16)."""
    return df.groupBy(uid).agg(F.max(correct).alias("_best"), F.count("*").alias("n")).where("_best < 0.5").select(uid, "n")


def select_groups(df: DataFrame, most: int, only_wrong: bool = False, uid: str = "uid", order: str = "sid", correct: str = "correct") -> DataFrame:
    """The first ``most`` groups by their first member, optionally of the all-wrong ones (A-12): uid, place, n, ratio."""
    groups = df.groupBy(uid).agg(F.min(order).alias("_first"), F.count("*").alias("n"), F.avg(correct).alias("ratio"), F.max(correct).alias("_best"))
    kept = groups.where("_best < 0.5") if only_wrong else groups
    top = kept.orderBy("_first", uid).limit(most)  # a report: the limit is the feature, and bounds the window below
    return top.select(uid, F.row_number().over(Window.orderBy("_first", uid)).alias("place"), "n", "ratio")


def correct_ratios(df: DataFrame, uid: str = "uid", correct: str = "correct") -> DataFrame:
    """One row of statistics over the groups' correct ratios (A-06); the deviation is that of the population."""
    r = df.groupBy(uid).agg(F.avg(correct).alias("ratio"))
    return r.agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"), F.min("ratio").alias("least"), F.max("ratio").alias("most"), *[F.percentile("ratio", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.count("*").alias("groups"))


def correct_histogram(df: DataFrame, size: int, uid: str = "uid", correct: str = "correct") -> DataFrame:
    """Groups of exactly ``size`` members by their number of correct ones (A-06): k, groups."""
    r = df.groupBy(uid).agg(F.avg(correct).alias("ratio"), F.count("*").alias("n")).where(F.col("n") == size)
    return r.groupBy(F.round(F.col("ratio") * size).cast("long").alias("k")).agg(F.count("*").alias("groups"))


def task_ops(df: DataFrame, weights: dict[str, float], least: int, eps: float = EPS, task: str = "task", value: str = "advantage") -> DataFrame:
    """``value`` weighted by task ('*' is the fallback, else 1), then whitened within tasks of ``least`` rows or more (W-14, J-10)."""
    own = F.create_map(*[F.lit(x) for k, v in weights.items() if k != "*" for x in (k, float(v))]) if set(weights) - {"*"} else None
    fallback = F.lit(float(weights.get("*", 1.0)))
    weighted = df.withColumn(value, F.col(value) * (F.coalesce(own[F.col(task)], fallback) if own is not None else fallback))
    # statistics first, by task: a task may hold a third of all rows, so they are pre-aggregated and joined, not windowed
    stats = weighted.groupBy(task).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count("*").alias("_n"))
    joined = weighted.join(stats, task)
    return joined.withColumn(value, F.when(F.col("_n") >= least, (F.col(value) - F.col("_mean")) / (F.col("_std") + eps)).otherwise(F.col(value))).drop("_mean", "_std", "_n")


def task_ops_masked(df: DataFrame, weights: dict[str, float], least: int, eps: float = EPS, task: str = "task", values: str = "advantages", mask: str = "mask") -> DataFrame:
    """The same over arrays of tokens: weights for all, whitening by the statistics of a task's masked tokens, of masked tokens only (W-14).

    A task with fewer than ``least`` masked tokens keeps its weighted values. Tokens are aggregated by task map-side; a null task is 'unknown'.
    """
    own = F.create_map(*[F.lit(x) for k, v in weights.items() if k != "*" for x in (k, float(v))]) if set(weights) - {"*"} else None
    named = F.coalesce(F.nullif(F.col(task), F.lit("")), F.lit("unknown"))
    factor = F.coalesce(own[named], F.lit(float(weights.get("*", 1.0)))) if own is not None else F.lit(float(weights.get("*", 1.0)))
    weighted = df.withColumn("_task", named).withColumn(values, F.transform(values, lambda x: x * factor))
    tokens = weighted.select("_task", F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).where("t.m = 1")
    stats = tokens.groupBy("_task").agg(F.avg("t.v").alias("_mean"), F.stddev_pop("t.v").alias("_std"), F.count("*").alias("_n"))
    white = F.zip_with(values, mask, lambda x, m: F.when(m == 1, (x - F.col("_mean")) / (F.col("_std") + eps)).otherwise(x))
    return weighted.join(stats, "_task", "left").withColumn(values, F.when(F.col("_n") >= least, white).otherwise(F.col(values))).drop("_task", "_mean", "_std", "_n")


def weak_classes(df: DataFrame, threshold: float, bottom: int, task: str = "task", score: str = "score") -> DataFrame:
    """Classes whose mean score is at most ``threshold``; where there is none, the ``bottom`` lowest (A-20)."""
    means = df.groupBy(task).agg(F.avg(score).alias("mean"))
    ranked = means.withColumn("_weak", F.col("mean") <= threshold).withColumn("_any", F.max("_weak").over(Window.partitionBy())).withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy("mean", task)))
    return ranked.where(F.col("_weak") | (~F.col("_any") & (F.col("_rank") <= bottom))).select(task, "mean")


def first_usable(*columns: str) -> Column:
    """The first of the named columns that holds a value (A-07)."""
    return F.coalesce(*[F.col(c).cast("double") for c in columns])


ESTIMATORS = {"grpo": grpo, "pass_at_k": pass_at_k, "rloo": rloo}


def estimate(name: str, df: DataFrame, **options) -> DataFrame:
    """An advantage estimator by its registered name (W-07)."""
    if name not in ESTIMATORS:
        raise ValueError(f"no advantage estimator is named {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](df, **options)
