"""Views over the driver's tables, for Spark and, as text, for the oracle."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share: below spark.checkpoint.dir; a temporary one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """A row per sampled response: group uid, id sid, task, score and a 0/1 correctness."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("sid"), F.col("event_type").alias("task"), F.col("value").alias("score"), (F.col("value") > 60).cast("int").alias("correct"))


ROLLOUTS = "rollouts AS (SELECT user_id AS uid, event_id AS sid, event_type AS task, value AS score, CAST(value > 60 AS INTEGER) AS correct FROM events)"


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per sequence: arrays of 64 per-token values and a mask whose first 64 - vec_id % 32 entries are 1."""
    e = table(spark, folder, "embeddings")
    n = (64 - F.col("vec_id") % 32).cast("int")
    return e.select("vec_id", F.col("label").alias("uid"), F.transform("embedding", lambda x: x.cast("double")).alias("arr"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i <= n).cast("int")).alias("mask"))


TOKENS = "tokens AS (SELECT vec_id, label AS uid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS arr, list_transform(range(1, 65), lambda i: CAST(i <= 64 - vec_id % 32 AS INTEGER)) AS mask FROM embeddings)"


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text answers to lettered questions: tagged, bare, pairs, same/different, with and without confidence."""
    e = table(spark, folder, "events")
    letter = F.chr(65 + F.col("event_id") % 5)
    other = F.chr(65 + (F.col("event_id") + 2) % 5)
    gold = F.chr(65 + F.col("user_id") % 5)
    second = F.chr(65 + (F.col("user_id") + 2) % 5)
    kind = F.col("event_id") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("I think it is "), letter))
        .when(kind == 1, F.concat(F.lit("<answer> "), letter, F.lit(" and "), other, F.lit(" </answer>")))
        .when(kind == 2, F.concat(F.lit("<ANSWER>"), F.when(F.col("event_id") % 2 == 0, "same").otherwise("Different"), F.lit("</ANSWER>")))
        .when(kind == 3, F.concat(F.lit("answer: "), F.when(F.col("event_id") % 3 == 0, "malignant").when(F.col("event_id") % 3 == 1, "benign").otherwise("unsure"), F.lit(" confidence = 0."), (F.col("event_id") % 10).cast("string")))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(F.lit("so <answer>"), F.when(F.col("event_id") % 3 == 0, "malignant").otherwise("benign"), F.lit("</answer> <confidence>"), (F.col("event_id") % 101).cast("string"), F.lit("</confidence>")))
        .otherwise(F.concat(F.lit("<answer> "), letter, F.lit(" </answer>")))
    )
    answer = F.when(kind == 1, F.concat(gold, F.lit(" "), second)).when(kind == 2, F.when(F.col("user_id") % 2 == 0, "same").otherwise("different")).when(kind.isin(3, 5), F.when(F.col("user_id") % 2 == 0, "malignant").otherwise("benign")).otherwise(gold)
    return e.select(F.col("event_id").alias("sid"), F.col("user_id").alias("uid"), F.col("event_type").alias("task"), text.alias("response"), answer.alias("gold"))


RESPONSES = """responses AS (SELECT event_id AS sid, user_id AS uid, event_type AS task,
  CASE event_id % 7 WHEN 0 THEN 'I think it is ' || chr(CAST(65 + event_id % 5 AS INTEGER))
    WHEN 1 THEN '<answer> ' || chr(CAST(65 + event_id % 5 AS INTEGER)) || ' and ' || chr(CAST(65 + (event_id + 2) % 5 AS INTEGER)) || ' </answer>'
    WHEN 2 THEN '<ANSWER>' || CASE WHEN event_id % 2 = 0 THEN 'same' ELSE 'Different' END || '</ANSWER>'
    WHEN 3 THEN 'answer: ' || CASE event_id % 3 WHEN 0 THEN 'malignant' WHEN 1 THEN 'benign' ELSE 'unsure' END || ' confidence = 0.' || CAST(event_id % 10 AS VARCHAR)
    WHEN 4 THEN ''
    WHEN 5 THEN 'so <answer>' || CASE WHEN event_id % 3 = 0 THEN 'malignant' ELSE 'benign' END || '</answer> <confidence>' || CAST(event_id % 101 AS VARCHAR) || '</confidence>'
    ELSE '<answer> ' || chr(CAST(65 + event_id % 5 AS INTEGER)) || ' </answer>' END AS response,
  CASE WHEN event_id % 7 = 1 THEN chr(CAST(65 + user_id % 5 AS INTEGER)) || ' ' || chr(CAST(65 + (user_id + 2) % 5 AS INTEGER))
    WHEN event_id % 7 = 2 THEN CASE WHEN user_id % 2 = 0 THEN 'same' ELSE 'different' END
    WHEN event_id % 7 IN (3, 5) THEN CASE WHEN user_id % 2 = 0 THEN 'malignant' ELSE 'benign' END
    ELSE chr(CAST(65 + user_id % 5 AS INTEGER)) END AS gold FROM events)"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled items in label spaces: image, label and space."""
    p = table(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("image"), F.col("p_brand").alias("label"), F.col("p_type").alias("space"))


ITEMS = "items AS (SELECT p_partkey AS image, p_brand AS label, p_type AS space FROM part)"


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Per-step counts by task: step is the day."""
    e = table(spark, folder, "events")
    return e.groupBy(F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("step"), F.col("event_type").alias("task")).agg(F.sum((F.col("value") > 60).cast("long")).alias("correct"), F.count("*").alias("total"))


STEPS = "steps AS (SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS step, event_type AS task, CAST(sum(CAST(value > 60 AS INTEGER)) AS BIGINT) AS correct, count(*) AS total FROM events GROUP BY 1, 2)"
