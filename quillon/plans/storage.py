"""Queries over readers and writers: tables are written to a shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as J
from ..operators import validate as V
from ..sources import io as S
from .registry import query
from .views import scratch, table

EVENTS = "SELECT event_id, event_type, value FROM events"


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "event_type", "value")


@query("jsonl_round_trip", EVENTS)
def jsonl_round_trip(spark, folder):
    """JSON lines in two goes, a null left in each line that has one."""
    path, df = scratch(spark, "jsonl"), _events(spark, folder)
    S.write_jsonl(df.where("event_type = 'click'"), path)
    S.write_jsonl(df.where("event_type <> 'click' or event_type is null"), path, append=True)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double").drop("file")


@query("jsonl_lenient", "SELECT event_id, event_id % 4 = 3 AS bad, CASE WHEN event_id % 4 = 3 THEN '{\"id\": ' || event_id || ', \"kind\"' END AS line FROM events")
def jsonl_lenient(spark, folder):
    """Good rows and bad lines of one file; a fourth of the lines are cut off."""
    path, i = scratch(spark, "lenient"), F.col("event_id").cast("string")
    start = F.concat(F.lit('{"id": '), i, F.lit(', "kind"'))
    table(spark, folder, "events").select(F.when(F.col("event_id") % 4 == 3, start).otherwise(F.concat(start, F.lit(': "k"}'))).alias("value")).write.text(path)
    good, bad = S.read_jsonl_lenient(spark, path, "id long, kind string")
    faulty = bad.select(F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("event_id"), F.lit(True).alias("bad"), "line")
    return good.select(F.col("id").alias("event_id"), F.lit(False).alias("bad"), F.lit(None).cast("string").alias("line")).unionByName(faulty)


@query("split_files", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def split_files(spark, folder):
    """A folder a type, and one aggregate over each when read again."""
    path = scratch(spark, "split")
    S.write_split(table(spark, folder, "events").select("event_id", "event_type"), path, "event_type")
    back = spark.read.schema("event_id long, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("replaced_table", "SELECT event_id, value * 2 AS value FROM events")
def replaced_table(spark, folder):
    """A table overwritten by what was read from it."""
    path = scratch(spark, "replaced")
    _events(spark, folder).select("event_id", "value").write.parquet(path)
    S.replace_table(spark, spark.read.parquet(path).withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(path)


@query("orc_split", "SELECT o_orderkey, o_orderstatus AS split FROM orders WHERE o_orderstatus = 'F'")
def orc_split(spark, folder):
    """One split of a table named by its path."""
    path = scratch(spark, "orders") + ".orc"
    table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")).write.orc(path)
    return S.read_table(spark, f"{path}@F")


@query("discovered", """WITH f AS (SELECT 'data/' || CASE event_id % 2 WHEN 0 THEN 'own' ELSE 'other' END || '/set' || (event_id % 50) || '_' || (event_id % 3) || '.json' AS path, 'set' || (event_id % 50) || '_' || (event_id % 3) AS stem, event_id % 2 AS r FROM events)
SELECT stem, arg_min(path, (r, path)) AS path FROM f GROUP BY stem""")
def discovered(spark, folder):
    """Data sets by the stems of their paths; the folder ``own`` wins."""
    e = F.col("event_id")
    path = F.concat(F.lit("data/"), F.when(e % 2 == 0, "own").otherwise("other"), F.lit("/set"), (e % 50).cast("string"), F.lit("_"), (e % 3).cast("string"), F.lit(".json"))
    return S.discover(table(spark, folder, "events").select(path.alias("path")), "own")


@query("decoded_truth", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": ' || event_id || '}' WHEN 1 THEN '["it''s None", true, null]' WHEN 2 THEN '["' || 'plain ' || event_id || '"]' ELSE '"quoted"' END AS truth FROM events""")
def decoded_truth(spark, folder):
    """JSON, literals and plain text as JSON."""
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('{"a": '), e.cast("string"), F.lit("}"))).when(e % 4 == 1, F.lit('["it\'s None", True, None]')).when(e % 4 == 2, F.concat(F.lit("plain "), e.cast("string"))).otherwise(F.lit('"quoted"'))
    return table(spark, folder, "events").select("event_id", S.decode_truth(raw).alias("truth"))


@query("resumed_ids", """WITH old AS (SELECT event_type AS kind, max(event_id % 1000) AS last FROM events WHERE event_type <> 'view' GROUP BY 1),
c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS kind FROM customer)
SELECT c_custkey, c.kind || '_' || printf('%06d', CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY c.kind ORDER BY c_custkey) AS BIGINT)) AS id FROM c LEFT JOIN old ON old.kind = c.kind""")
def resumed_ids(spark, folder):
    """Ids that go on after the highest one of each prefix that is there."""
    done = table(spark, folder, "events").where("event_type <> 'view'").select(F.format_string("%s_%06d", "event_type", F.col("event_id") % 1000).alias("id"))
    kind = F.when(F.col("c_custkey") % 3 == 0, "click").when(F.col("c_custkey") % 3 == 1, "view").otherwise("purchase")
    new = table(spark, folder, "customer").select("c_custkey", kind.alias("kind"))
    return S.numbered_after(new, "kind", "c_custkey", S.resume_state(done, "id", r"^(\w+)_(\d+)$")).select("c_custkey", "id")


@query("cached_requests", """WITH r AS (SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS key FROM events), c AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS key, c_name AS answer FROM customer)
SELECT event_id, answer, answer IS NULL AS asked FROM r LEFT JOIN c USING (key)""")
def cached_requests(spark, folder):
    """Requests that the cache answers, and those still to ask."""
    key = lambda c: F.md5(F.col(c).cast("string").cast("binary")).alias("key")
    known, new = S.cached_responses(table(spark, folder, "events").select("event_id", key("user_id")), table(spark, folder, "customer").select(key("c_custkey"), F.col("c_name").alias("answer")), "key")
    return known.select("event_id", "answer", F.lit(False).alias("asked")).unionByName(new.select("event_id", F.lit(None).cast("string").alias("answer"), F.lit(True).alias("asked")))


@query("leaking_turns", """SELECT conv_id, turn, regexp_matches(lower(text), 'diagnos|model') OR contains(' ' || trim(regexp_replace(lower(text || ' ' || role), '[^a-z0-9]+', ' ', 'g')) || ' ', ' assistant ') AS leaks,
length(text) >= 40 AS quotes, turn < 1 OR turn + 1 > 3 AS outside FROM conversations""")
def leaking_turns(spark, folder):
    """Rule checks over turns: forbidden words or labels, evidence quoted word for word, lines out of range."""
    c, turn = table(spark, folder, "conversations"), F.col("turn")
    leaks = V.leaks(F.col("text"), F.col("role"), ["assistant"], "diagnos|model")
    return c.select("conv_id", "turn", leaks.alias("leaks"), V.quotes(F.concat(F.lit("see "), "text"), F.array("text")).alias("quotes"), V.outside(F.array(turn, turn + 1), 1, 3).alias("outside"))
