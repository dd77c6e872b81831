"""Readers and writers: JSON lines, JSON lists, logs, tables, and their bookkeeping."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Strict JSON lines (S-01): blank lines are skipped, a bad line fails the job. ``file`` names the source."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))


def read_jsonl_lenient(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines (S-02)."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), parsed.alias("r"))
    return lines.where("r._bad is null").select("r.*").drop("_bad"), lines.where("r._bad is not null").select("line")


def read_json_list(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files that each hold one list of objects (S-03)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed objects one after another (Q-07): cut where a line closes an object and the next one opens."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.split("value", r"(?m)(?<=^\})\s*(?=^\{)")).alias("v")).where("trim(v) <> ''").select(F.from_json("v", schema).alias("r")).select("r.*")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A file or folder by its extension; name@split reads one split (S-06, S-11)."""
    path, _, part = name.partition("@")
    kind = next((k for k in ("parquet", "json", "jsonl", "csv", "orc") if path.rstrip("/").endswith("." + k)), "parquet")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    df = reader.format("json" if kind == "jsonl" else kind).load(path)
    return df.where(F.col("split") == part) if part else df


def discover(files: DataFrame, first: str) -> DataFrame:
    """stem and path of each dataset; where two folders have a name, the one named ``first`` wins (S-04)."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rank = F.when(F.contains(F.col("path"), F.lit(f"/{first}/")), 0).otherwise(1)
    own = Window.partitionBy("stem").orderBy("_rank", "path")
    return files.withColumn("stem", stem).withColumn("_rank", rank).withColumn("_n", F.row_number().over(own)).where("_n = 1").select("stem", "path")


def parse_log(text: Column) -> Column:
    """An array of struct(prompt, output, ground_truth, score) from marker-delimited blocks (S-09). An unreadable score is NaN."""
    blocks = F.filter(F.split(text, r"(?m)^\[prompt\] "), lambda b: F.contains(b, F.lit("[output] ")))

    def block(b: Column) -> Column:
        part = lambda a, z: F.regexp_extract(b, rf"(?s){a}(.*?)\n{z}", 1)
        score = F.regexp_extract(b, r"(?s)\n\[score\] (\S+)", 1).try_cast("double")
        return F.struct(part("^", r"\[output\] ").alias("prompt"), part(r"\n\[output\] ", r"\[ground_truth\] ").alias("output"), part(r"\n\[ground_truth\] ", r"\[score\] ").alias("ground_truth"), F.coalesce(score, F.lit(float("nan"))).alias("score"))

    return F.transform(blocks, block)


def decode_truth(raw: Column) -> Column:
    """JSON text as it is; literals with single quotes, None, True and False as JSON; anything else as a JSON string (S-10).

    Words and quotes inside a string stay: the text is cut into strings and what is between them, and each is rewritten alone.
    """
    parts = F.regexp_extract_all(raw, F.lit(r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^'\"]+|['\"]"""), F.lit(0))

    def part(x: Column) -> Column:
        inner = F.replace(F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        words = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        return F.when(x.startswith("'") & (F.length(x) > 1), F.concat(F.lit('"'), inner, F.lit('"'))).when(x.startswith('"'), x).otherwise(words)

    as_json = F.array_join(F.transform(parts, part), "")
    return F.when(F.try_parse_json(raw).isNotNull(), raw).when(F.try_parse_json(as_json).isNotNull(), as_json).otherwise(F.to_json(F.array(raw)))


def resume_state(existing: DataFrame, column: str, pattern: str) -> DataFrame:
    """The highest number of each prefix of an id column, to go on from (S-14, H-02)."""
    return existing.select(F.regexp_extract(column, pattern, 1).alias("prefix"), F.regexp_extract(column, pattern, 2).try_cast("long").alias("n")).where("prefix <> ''").groupBy("prefix").agg(F.max("n").alias("last"))


def numbered_after(df: DataFrame, prefix: str, order: str, state: DataFrame) -> DataFrame:
    """Ids that go on after ``state`` (W-22)."""
    rank = F.row_number().over(Window.partitionBy(prefix).orderBy(order))
    joined = df.withColumn("_rank", rank).join(state.withColumnRenamed("prefix", prefix), prefix, "left")
    return joined.withColumn("id", F.format_string("%s_%06d", F.col(prefix), F.coalesce("last", F.lit(0)) + F.col("_rank"))).drop("_rank", "last")


def write_jsonl(df: DataFrame, path: str, append: bool = False, overwrite: bool = False, order: str | None = None) -> None:
    """JSON lines (K-01..K-03). An existing path is an error unless told otherwise; ``order`` sorts over all files."""
    ordered = df.orderBy(order) if order else df
    ordered.write.mode("append" if append else "overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside, then rename twice (K-04): a path is never read and overwritten by one job, and its old rows stay until the new ones are there.

    A crash between the renames leaves both tables beside the path, as .old and .staging; the next call starts from .old then.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staging, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".staging", ".old"))
    fs = target.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(staging.toString())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{target} could not be moved aside")
    if not fs.rename(staging, target):
        raise OSError(f"{staging} could not be renamed to {target}")
    fs.delete(old, True)


def write_split(df: DataFrame, path: str, column: str) -> None:
    """One folder per value (K-05)."""
    df.write.partitionBy(column).json(path)


def write_summary(df: DataFrame, path: str) -> dict[str, Any]:
    """One aggregated row as JSON beside the data (K-06); returned as a dict."""
    row = df.select(F.to_json(F.struct("*")).alias("value")).first()[0]
    df.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return json.loads(row)


def write_metrics(spark: SparkSession, values: dict[str, float], step: int, path: str) -> None:
    """A row per metric, appended (K-09)."""
    spark.createDataFrame([(step, k, float(v)) for k, v in values.items()], "step long, metric string, value double").write.mode("append").parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Prompt, output, label and score rows, appended (K-10, K-11)."""
    df.write.mode("append").parquet(path)


def update_tracker(spark: SparkSession, path: str, step: int, score: float) -> dict[str, Any]:
    """Best step, best score and last step as one row, rewritten (K-12). The first of equal scores stays best."""
    try:
        old = spark.read.parquet(path).first().asDict()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = {"best_step": step, "best_score": score}
    new = {"best_step": step, "best_score": score} if score > old["best_score"] else {k: old[k] for k in ("best_step", "best_score")}
    new["last_step"] = step
    replace_table(spark, spark.createDataFrame([new], "best_step long, best_score double, last_step long"), path)
    return new


def cached_responses(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answered from the cache, still to ask) by request key (H-01)."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")
