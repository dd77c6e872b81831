"""Metric aggregation: lengths, valid tokens, tasks, steps, and evaluation results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_means(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """The mean of each metric (A-01)."""
    return df.groupBy(metric).agg(F.avg(value).alias("mean"))


def length_stats(df: DataFrame, length: str, cap: int) -> list[Column]:
    """Aggregates of a length column: mean, max, min and the share at the cap (A-02)."""
    return [F.avg(length).alias(f"{length}_mean"), F.max(length).alias(f"{length}_max"), F.min(length).alias(f"{length}_min"), F.avg((F.col(length) == cap).cast("double")).alias(f"{length}_capped")]


def valid_tokens(df: DataFrame, values: str, mask: str, out: str) -> DataFrame:
    """A row per valid token (A-03)."""
    kept = F.filter(F.zip_with(values, mask, lambda x, m: F.when(m == 1, x)), lambda x: x.isNotNull())
    return df.select(F.explode(kept).alias(out))


def spread_stats(name: str) -> list[Column]:
    return [F.avg(name).alias("mean"), F.max(name).alias("most"), F.min(name).alias("least")]


def explained_variance(returns: Column, values: Column) -> Column:
    """1 - var(returns - values) / (var(returns) + 1e-5) (A-03)."""
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def timing(seconds: dict[str, Column], tokens: Column) -> list[Column]:
    """Seconds of each section and milliseconds a token (A-04)."""
    return [s.alias(f"{k}_s") for k, s in seconds.items()] + [(s * 1000 / tokens).alias(f"{k}_ms_per_token") for k, s in seconds.items()]


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    """Tokens per second and device (A-05)."""
    return tokens / (seconds * devices)


def flops(length: str, dense: float, attention: float) -> Column:
    """An estimate from the sums of lengths and of their squares (A-23)."""
    n = F.col(length).cast("double")
    return F.sum(n) * dense + F.sum(n * n) * attention


def task_accuracy(df: DataFrame, task: str = "task", correct: str = "correct") -> DataFrame:
    """task, correct, total, acc for each task and over all ('overall'), best first by acc, total, name (A-09, L-15)."""
    rows = df.rollup(task).agg(F.sum(correct).cast("long").alias("correct"), F.count("*").alias("total"), F.grouping(task).alias("_all"))
    named = rows.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col(task)).alias("task"), "correct", "total", F.try_divide("correct", "total").alias("acc"))
    return named.orderBy(F.desc("acc"), F.desc("total"), "task")


def correctness(acc: Column, overall: Column, predicted: Column, gold: Column) -> tuple[Column, Column]:
    """(1/0 or null, rule used) of a record: a usable accuracy, else the score's sign, else the answers compared (A-10, F-38)."""
    number = lambda c: F.when(F.isnan(c.cast("double")), None).otherwise(c.cast("double"))
    rule = F.when(number(acc).isNotNull(), "acc").when(number(overall).isNotNull(), "overall").when(predicted.isNotNull() & gold.isNotNull(), "answer").otherwise("none")
    value = F.when(rule == "acc", (number(acc) >= 0.5).cast("int")).when(rule == "overall", (number(overall) > 0).cast("int")).when(rule == "answer", (predicted == gold).cast("int"))
    return value, rule


def summary(df: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent values, ties by value (A-08): a report."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def batch_task_metrics(df: DataFrame, batch: str, task: str = "task", correct: str = "correct") -> DataFrame:
    """n, correct and acc of each task of a batch, on every row of the batch as a map (A-13)."""
    per = df.groupBy(batch, task).agg(F.count("*").alias("n"), F.sum(correct).alias("c"))
    maps = per.groupBy(batch).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(task), (F.col("c") / F.col("n")).alias("acc"))))).alias("task_acc"))
    return df.join(maps, batch)


def coverage(df: DataFrame, answered: str = "answered", acc: str = "acc") -> DataFrame:
    """One row: coverage, unsure rate and accuracy over answered records (A-14)."""
    return df.agg(F.avg(answered).alias("coverage"), (1 - F.avg(answered)).alias("unsure_rate"), F.coalesce(F.try_divide(F.sum(F.col(acc) * F.col(answered)), F.sum(answered)), F.lit(0.0)).alias("selective_acc"))


def rolling(df: DataFrame, steps: int, task: str = "task", step: str = "step") -> DataFrame:
    """Accuracy over a task's last ``steps`` steps that have it (W-17)."""
    w = Window.partitionBy(task).orderBy(step).rowsBetween(-(steps - 1), 0)
    return df.withColumn("rolling_acc", F.sum("correct").over(w) / F.sum("total").over(w))


def ema(df: DataFrame, decay: float, task: str = "task", step: str = "step") -> DataFrame:
    """Ratio of exponentially averaged counts after each step (W-16); both averages start from 0, so the first step has no more weight than others.

    Folded over each task's steps in order; a step is one row however many responses it had, so the list is short.
    """
    rows = df.groupBy(task).agg(F.sort_array(F.collect_list(F.struct(step, "correct", "total"))).alias("_steps"))

    @F.pandas_udf("array<double>")
    def mixed(correct: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for own, all_ in zip(correct, total, strict=True):
            c = t = 0.0
            ratios = []
            for x, n in zip(own, all_, strict=True):
                c, t = decay * c + (1 - decay) * x, decay * t + (1 - decay) * n
                ratios.append(c / t if t else None)
            out.append(ratios)
        return pd.Series(out)

    part = lambda name: F.transform("_steps", lambda s: s[name])
    folded = rows.select(task, F.explode(F.arrays_zip(part(step).alias("step"), mixed(part("correct"), part("total")).alias("ema"))).alias("_row"))
    return folded.select(task, F.col("_row.step").cast("long").alias(step), F.col("_row.ema").alias("ema"))


def epochs(df: DataFrame, batch: int, rows: int, least: int, task: str = "task", step: str = "step") -> DataFrame:
    """Accuracy by epoch floor(step * batch / rows), for closed epochs with ``least`` samples (W-18). The last one is open."""
    e = df.withColumn("epoch", F.floor(F.col(step) * batch / rows))
    last = e.agg(F.max("epoch").alias("_last"))
    per = e.groupBy(task, "epoch").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return per.crossJoin(F.broadcast(last)).where((F.col("epoch") < F.col("_last")) & (F.col("total") >= least)).select(task, "epoch", (F.col("correct") / F.col("total")).alias("acc"))


def two_stage(df: DataFrame) -> DataFrame:
    """Per task of records (task, images, images_correct, final): image accuracy, all-correct rate and final accuracy (A-11)."""
    return df.groupBy("task").agg(F.count("*").alias("n"), (F.sum("images_correct") / F.sum("images")).alias("image_acc"), F.avg((F.col("images_correct") == F.col("images")).cast("double")).alias("all_correct"), F.avg("final").alias("final_acc"))


def two_stage_buckets(df: DataFrame) -> DataFrame:
    """Final accuracy by task and (images, images correct) (A-11)."""
    return df.groupBy("task", "images", "images_correct").agg(F.count("*").alias("n"), F.avg("final").alias("final_acc"))


def validation(df: DataFrame, batch: str, reward: str, length: str) -> DataFrame:
    """One row (A-26): rewards pooled over all rows; lengths as the plain mean of the batches' means and maxima, and over all rows."""
    per = df.groupBy(batch).agg(F.sum(reward).alias("_reward"), F.count("*").alias("_n"), F.avg(length).alias("_mean"), F.max(length).alias("_max"), F.sum(length).alias("_length"))
    return per.agg((F.sum("_reward") / F.sum("_n")).alias("reward"), F.avg("_mean").alias("length_mean_of_batches"), F.avg("_max").alias("length_max_of_batches"), (F.sum("_length") / F.sum("_n")).alias("length_mean"))


def problems(df: DataFrame, codes: str, key: str, examples: int) -> DataFrame:
    """code, n and the first ``examples`` keys of an array column of problem codes (A-19)."""
    each = df.select(F.col(key).alias("_key"), F.explode(codes).alias("code"))
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy("code").orderBy("_key"))).where(F.col("_rank") <= examples)
    shown = ranked.groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("_key")), ",").alias("examples"))
    return each.groupBy("code").agg(F.count("*").alias("n")).join(shown, "code")
