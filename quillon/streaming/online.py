"""Online ingestion: payloads arrive as files of JSON lines, are normalised, topped up, counted and fed back.

Progress lives in the stream's checkpoint, so a restart neither loses nor repeats a payload (X-07). Stateful counts
use complete mode; time plays no role, so there is no watermark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import metrics as M
from ..operators import sampling as L
from ..operators.reshape import first_filled

PAYLOAD = "prompt string, question string, problem string, images array<string>, image string, answer string, label string, meta struct<class_label:string,must_include:array<string>>"


def source(spark: SparkSession, folder: str, schema: str = PAYLOAD, per_trigger: int = 100) -> DataFrame:
    """A folder that producers drop JSON lines into (X-01, S-15)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def normalised(payloads: DataFrame) -> DataFrame:
    """prompt, images and answer by their alias chains (P-21); rows without a prompt are left out."""
    images = F.coalesce(F.col("images"), F.when(F.col("image").isNotNull(), F.array("image")), F.array().cast("array<string>"))
    answer = F.to_json(F.struct(first_filled(F.col("answer"), F.col("label"), F.col("meta.class_label")).alias("label"), F.col("meta.must_include").alias("must_include")))
    return payloads.select(first_filled(F.col("prompt"), F.col("question"), F.col("problem")).alias("prompt"), images.alias("images"), answer.alias("answer")).where(F.col("prompt").isNotNull())


def dropped_overlong(rows: DataFrame, most: int, name: str = "drops") -> DataFrame:
    """Rows of at most ``most`` words; seen and dropped are observed under ``name`` (X-03, A-21, C-05)."""
    marked = rows.withColumn("_long", X.token_count(F.col("prompt")) > most)
    return marked.observe(name, F.count("*").alias("seen"), F.sum(F.col("_long").cast("long")).alias("dropped")).where(~F.col("_long")).drop("_long")


def topped_up(batch: DataFrame, static: DataFrame, key: str, least: int, seed: int, epoch: int) -> DataFrame:
    """A short micro-batch filled from a static set by hashed draw (X-02)."""
    missing = least - batch.limit(least).count()
    return batch if missing <= 0 else batch.unionByName(L.sample(static, key, seed, f"top-{epoch}", missing).select(*batch.columns))


def mixed(batch: DataFrame, static: DataFrame, key: str, probability: float, seed: int, epoch: int) -> DataFrame:
    """A micro-batch with rows of a static set among its own: ``probability`` of all rows on average, none of its own lost (X-02).

    A row draws from the static set with the given probability before each of its own is taken, so rows * p / (1 - p) are
    added, the remainder by a hashed coin. An empty batch stays empty; ``topped_up`` fills that. More rows than the static set
    has are taken with replacement.
    """
    if not 0 <= probability < 1:
        raise ValueError("a probability of at least 0 and less than 1 is needed")
    wanted = batch.count() * probability / (1 - probability)
    coin = int(hashlib.md5(f"{seed}|mixed|{epoch}".encode()).hexdigest()[:8], 16) / 2**32
    n = int(wanted) + (coin < wanted - int(wanted))
    rows = static.count()
    return batch if not n or not rows else batch.unionByName(L.oversample(static, key, seed, f"mixed-{epoch}", n, rows).select(*batch.columns))


def each_batch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``act`` on every micro-batch that is there now, then stop (X-06, X-08, K-13)."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Running counts by key, for complete mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def step_counts(path: str, task: str = "task", step: str = "step", correct: str = "correct") -> Callable[[DataFrame, int], None]:
    """A sink that keeps correct and total by task and step (X-08): one small folder a micro-batch, replaced where the batch is run again."""

    def act(batch: DataFrame, epoch: int) -> None:
        counted = batch.groupBy(F.coalesce(F.col(task), F.lit("unknown")).alias("task"), F.col(step).alias("step")).agg(F.coalesce(F.sum(F.col(correct).cast("long")), F.lit(0)).alias("correct"), F.count("*").alias("total"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return act


def task_curves(spark: SparkSession, path: str, decay: float, window: int) -> DataFrame:
    """Per task and step what ``step_counts`` kept so far gives: counts, their running averages and rolling sums (X-08).

    A step that came in several micro-batches is one step. ``metrics.epochs`` takes the same counts for closed epochs.
    """
    per = counted_steps(spark, path)
    return M.rolling(per, window).join(M.ema(per, decay), ["task", "step"])


def counted_steps(spark: SparkSession, path: str) -> DataFrame:
    """task, step, correct and total over all micro-batches."""
    kept = spark.read.schema("task string, step long, correct long, total long").parquet(path)
    return kept.groupBy("task", "step").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def feedback(path: str, choose: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites one small table with what ``choose`` finds; the last batch wins (X-04)."""

    def act(batch: DataFrame, epoch: int) -> None:
        choose(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(path)

    return act


def teacher(ticks: DataFrame, rows: DataFrame, weak: DataFrame, seed: int) -> DataFrame:
    """A payload per tick: a hashed row and a hashed weak class (X-05). rows has _pos and weak has _pos, both from 0."""
    n, k = rows.count(), weak.count()
    number = lambda op, most: F.pmod(F.conv(F.substring(L.draw(seed, op, "tick"), 1, 8), 16, 10).cast("long"), F.lit(most))
    picked = ticks.withColumn("_row", number("row", n)).withColumn("_weak", number("weak", max(k, 1)))
    return picked.join(rows, F.col("_row") == rows["_pos"]).drop("_pos", "_row").join(weak.withColumnRenamed("_pos", "_weak"), "_weak", "left").drop("_weak")


def until_enough(batches: Callable[[int], DataFrame], keep: Callable[[DataFrame], DataFrame], groups: int, tries: int, uid: str = "uid") -> DataFrame:
    """Generate and filter until ``groups`` groups survive, ``tries`` times at most (X-09); too few at the end is an error."""
    kept = None
    for attempt in range(tries):
        new = keep(batches(attempt))
        kept = new if kept is None else kept.unionByName(new)
        if kept.select(uid).distinct().limit(groups).count() >= groups:
            return kept
    raise RuntimeError(f"fewer than {groups} groups survived {tries} tries")
