"""Queries over metric aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query
from .views import ROLLOUTS, STEPS, TOKENS, rollouts, steps, table, tokens


def _r(c):
    return F.round(c, 6)


@query("length_metrics", """SELECT round(avg(n), 6) AS n_mean, max(n) AS n_max, min(n) AS n_min, round(avg(CASE WHEN n = 2048 THEN 1.0 ELSE 0.0 END), 6) AS n_capped FROM (SELECT least(n_chars, 2048) AS n FROM documents)""")
def length_metrics(spark, folder):
    df = table(spark, folder, "documents").select(F.least("n_chars", F.lit(2048)).alias("n"))
    out = df.agg(*M.length_stats(df, "n", 2048))
    return out.select(_r(F.col("n_mean")).alias("n_mean"), "n_max", "n_min", _r(F.col("n_capped")).alias("n_capped"))


@query("data_metrics", f"WITH {TOKENS}, t AS (SELECT arr[i] AS x, mask[i] AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM tokens)) SELECT round(avg(x), 6) AS mean, round(max(x), 6) AS most, round(min(x), 6) AS least FROM t WHERE m = 1")
def data_metrics(spark, folder):
    out = M.valid_tokens(tokens(spark, folder), "arr", "mask", "x").agg(*M.spread_stats("x"))
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])


@query("explained_variance", f"WITH {TOKENS}, t AS (SELECT arr[i] AS r, arr[65 - i] AS v, mask[i] AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM tokens)) SELECT round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) AS explained FROM t WHERE m = 1")
def explained_variance(spark, folder):
    df = tokens(spark, folder).select(F.explode(F.arrays_zip(F.col("arr").alias("r"), F.reverse("arr").alias("v"), F.col("mask").alias("m"))).alias("t")).where("t.m = 1")
    return df.agg(_r(M.explained_variance(F.col("t.r"), F.col("t.v"))).alias("explained"))


@query("reduce_metrics", "SELECT event_type AS metric, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def reduce_metrics(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("metric"), "value")
    return M.reduce_means(e).select("metric", _r(F.col("mean")).alias("mean"))


@query("timing_throughput", "SELECT conv_id, round(sum(length(text)) / 10.0, 6) AS gen_s, round(sum(length(text)) / 10.0 * 1000 / sum(length(text)), 6) AS gen_ms_per_token, round(sum(length(text)) / (sum(length(text)) / 10.0 * 8), 6) AS throughput FROM conversations GROUP BY conv_id HAVING sum(length(text)) > 0")
def timing_throughput(spark, folder):
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).where("n > 0")
    s = F.col("n") / 10.0
    return c.select("conv_id", *[_r(x).alias(name) for x, name in zip(M.timing({"gen": s}, F.col("n")), ("gen_s", "gen_ms_per_token"), strict=True)], _r(M.throughput(F.col("n"), s, 8)).alias("throughput"))


@query("flops_estimate", "SELECT lang, round(sum(CAST(n_chars AS DOUBLE)) * 6.5 + sum(CAST(n_chars AS DOUBLE) * n_chars) * 0.25, 3) AS flops FROM documents GROUP BY lang")
def flops_estimate(spark, folder):
    return table(spark, folder, "documents").groupBy("lang").agg(F.round(M.flops("n_chars", 6.5, 0.25), 3).alias("flops"))


@query("task_accuracy", f"WITH {ROLLOUTS} SELECT coalesce(task, 'overall') AS task, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total, round(sum(correct) / count(*), 6) AS acc FROM rollouts GROUP BY ROLLUP (task)")
def task_accuracy(spark, folder):
    return M.task_accuracy(rollouts(spark, folder)).withColumn("acc", _r(F.col("acc")))


@query("correctness_rule", f"""WITH {ROLLOUTS}, x AS (SELECT sid, CASE WHEN sid % 4 = 0 THEN score / 100 END AS acc, CASE WHEN sid % 4 = 1 THEN score - 50 END AS overall, CASE WHEN sid % 4 = 2 THEN task END AS predicted FROM rollouts)
SELECT sid, CASE WHEN acc IS NOT NULL THEN CAST(acc >= 0.5 AS INTEGER) WHEN overall IS NOT NULL THEN CAST(overall > 0 AS INTEGER) WHEN predicted IS NOT NULL THEN CAST(predicted = 'click' AS INTEGER) END AS correct,
 CASE WHEN acc IS NOT NULL THEN 'acc' WHEN overall IS NOT NULL THEN 'overall' WHEN predicted IS NOT NULL THEN 'answer' ELSE 'none' END AS rule FROM x""")
def correctness_rule(spark, folder):
    k = F.col("sid") % 4
    value, rule = M.correctness(F.when(k == 0, F.col("score") / 100), F.when(k == 1, F.col("score") - 50), F.when(k == 2, F.col("task")), F.lit("click"))
    return rollouts(spark, folder).select("sid", value.alias("correct"), rule.alias("rule"))


@query("summary_counters", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def summary_counters(spark, folder):
    return M.summary(table(spark, folder, "documents"), "source", 10)


@query("batch_task_metrics", f"""WITH {ROLLOUTS} SELECT sid, sid // 100 AS batch, round(avg(correct) OVER (PARTITION BY sid // 100, task), 6) AS acc FROM rollouts""")
def batch_task_metrics(spark, folder):
    df = M.batch_task_metrics(rollouts(spark, folder).withColumn("batch", F.floor(F.col("sid") / 100)), "batch")
    return df.select("sid", "batch", _r(F.col("task_acc")[F.col("task")]).alias("acc"))


@query("rolling_task_acc", f"WITH {STEPS} SELECT task, step, round(sum(correct) OVER w / sum(total) OVER w, 6) AS rolling_acc FROM steps WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_task_acc(spark, folder):
    return M.rolling(steps(spark, folder), 5).select("task", F.col("step").cast("long").alias("step"), _r(F.col("rolling_acc")).alias("rolling_acc"))


@query("ema_task_acc", f"""WITH RECURSIVE {STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY step) AS k FROM steps),
e AS (SELECT task, step, k, 0.1 * CAST(correct AS DOUBLE) AS c, 0.1 * CAST(total AS DOUBLE) AS t FROM n WHERE k = 1
 UNION ALL SELECT n.task, n.step, n.k, 0.9 * e.c + 0.1 * n.correct, 0.9 * e.t + 0.1 * n.total FROM e JOIN n ON n.task = e.task AND n.k = e.k + 1)
SELECT task, CAST(step AS BIGINT) AS step, round(c / t, 6) AS ema FROM e""")
def ema_task_acc(spark, folder):
    return M.ema(steps(spark, folder), 0.9).select("task", "step", _r(F.col("ema")).alias("ema"))


@query("epoch_task_acc", f"""WITH {STEPS}, e AS (SELECT task, step * 64 // 500 AS epoch, correct, total FROM steps), l AS (SELECT max(epoch) AS last FROM e)
SELECT task, CAST(epoch AS BIGINT) AS epoch, round(sum(correct) / sum(total), 6) AS acc FROM e, l WHERE epoch < last GROUP BY task, epoch HAVING sum(total) >= 10""")
def epoch_task_acc(spark, folder):
    return M.epochs(steps(spark, folder), 64, 500, 10).select("task", "epoch", _r(F.col("acc")).alias("acc"))


TWO = "x AS (SELECT event_type AS task, 3 AS images, CAST(event_id % 4 AS INTEGER) AS images_correct, CAST(value > 60 AS INTEGER) AS final FROM events)"


def _two(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.col("event_type").alias("task"), F.lit(3).alias("images"), (F.col("event_id") % 4).cast("int").alias("images_correct"), (F.col("value") > 60).cast("int").alias("final"))


@query("two_stage_metrics", f"WITH {TWO} SELECT task, count(*) AS n, round(sum(images_correct) / sum(images), 6) AS image_acc, round(avg(CAST(images_correct = images AS INTEGER)), 6) AS all_correct, round(avg(final), 6) AS final_acc FROM x GROUP BY task")
def two_stage_metrics(spark, folder):
    return M.two_stage(_two(spark, folder)).select("task", "n", *[_r(F.col(c)).alias(c) for c in ("image_acc", "all_correct", "final_acc")])


@query("two_stage_buckets", f"WITH {TWO} SELECT task, images, images_correct, count(*) AS n, round(avg(final), 6) AS final_acc FROM x GROUP BY 1, 2, 3")
def two_stage_buckets(spark, folder):
    return M.two_stage_buckets(_two(spark, folder)).withColumn("final_acc", _r(F.col("final_acc")))


@query("validation_metrics", """WITH b AS (SELECT event_id // 64 AS batch, sum(value) AS v, count(*) AS n, avg(length(props)) AS m, max(length(props)) AS x, sum(length(props)) AS l FROM events GROUP BY 1)
SELECT round(sum(v) / sum(n), 6) AS reward, round(avg(m), 6) AS length_mean_of_batches, round(avg(x), 6) AS length_max_of_batches, round(sum(l) / sum(n), 6) AS length_mean FROM b""")
def validation_metrics(spark, folder):
    e = table(spark, folder, "events").select(F.floor(F.col("event_id") / 64).alias("batch"), "value", F.length("props").alias("n"))
    out = M.validation(e, "batch", "value", "n")
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])
