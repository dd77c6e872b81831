"""Joins that look things up: by key with disambiguation, by rank, by presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disambiguated(left: DataFrame, right: DataFrame, key: str, row: str, matches: Column) -> DataFrame:
    """left with its one candidate of right and ``status`` (J-02): one candidate wins; of several the only one that ``matches``.

    status: matched, missing or ambiguous; the candidate's columns are null unless matched.
    """
    joined = left.join(right, key, "left").withColumn("_hit", F.when(F.coalesce(matches, F.lit(False)), 1).otherwise(0))
    own = Window.partitionBy(row)
    mark = [c for c in right.columns if c != key]
    counted = joined.withColumn("_n", F.count(mark[0]).over(own)).withColumn("_hits", F.sum("_hit").over(own))
    status = F.when(F.col("_n") == 0, "missing").when((F.col("_n") == 1) | (F.col("_hits") == 1), "matched").otherwise("ambiguous")
    picked = counted.withColumn("status", status).withColumn("_rank", F.row_number().over(own.orderBy(F.desc("_hit"), *mark))).where("_rank = 1")
    return picked.select(*left.columns, "status", *[F.when(F.col("status") == "matched", F.col(c)).alias(c) for c in mark])


def disambiguated_by_value(left: DataFrame, right: DataFrame, key: str, mark: str, want: str) -> DataFrame:
    """``disambiguated`` where a candidate matches if its ``mark`` is the row's ``want``, without pairing rows with candidates.

    right is aggregated by key, and by key and mark, before it is joined, so a key of many rows on both sides stays linear.
    Candidates without a first column don't count.
    """
    own = [c for c in right.columns if c != key]
    known = right.where(F.col(own[0]).isNotNull())
    each = known.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*own)).alias("_only"))
    hits = known.groupBy(key, F.col(mark).alias("_mark")).agg(F.count("*").alias("_hits"), F.min(F.struct(*own)).alias("_hit")).withColumnRenamed(key, "_key")
    joined = left.join(each, key, "left").join(hits, (F.col(key) == F.col("_key")) & (F.col(want) == F.col("_mark")), "left")
    status = F.when(F.col("_n").isNull(), "missing").when((F.col("_n") == 1) | (F.col("_hits") == 1), "matched").otherwise("ambiguous")
    picked = joined.withColumn("status", status).withColumn("_one", F.when(F.col("status") == "matched", F.coalesce("_hit", "_only")))
    return picked.select(*left.columns, "status", *[F.col("_one")[c].alias(c) for c in own])


def matched_in_order(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other (J-06): what greedy consumption gives when a match is an equal key."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "_n"]).drop("_n")


def by_answer_or_prompt(predictions: DataFrame, source: DataFrame, pattern: str = r"\[eval_id=(\d+)\]") -> DataFrame:
    """Predictions with their source rows by eval_id: the answer's own, else the one in the prompt (J-01). Others are left out."""
    found = F.coalesce(F.col("answer_eval_id"), F.nullif(F.regexp_extract("prompt", pattern, 1), F.lit("")).try_cast("long"))
    return predictions.withColumn("eval_id", found).join(source, "eval_id")


def with_fallback_pool(df: DataFrame, pools: DataFrame, key: str, pool: str, everything: str = "all") -> DataFrame:
    """The pool of a row's key, else the one named ``everything`` (J-05), null without that one."""
    rest = pools.where(F.col(key) == everything).agg(F.max(pool).alias("_rest"))  # always one row
    return df.join(pools.where(F.col(key) != everything), key, "left").crossJoin(F.broadcast(rest)).withColumn(pool, F.coalesce(pool, "_rest")).drop("_rest")


def unknown_names(names: list[str], known: DataFrame, column: str) -> DataFrame:
    """Requested names that aren't there (S-05, J-08)."""
    asked = known.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return asked.join(known.select(column).distinct(), column, "left_anti")
