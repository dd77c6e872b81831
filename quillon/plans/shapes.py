"""Queries over joins, rewrites, validation, balancing and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import balance as Q
from ..operators import lookup as J
from ..operators import metrics as M
from ..operators import reshape as P
from ..operators import validate as V
from ..sources import io as S
from ..streaming import online as O
from .registry import query
from .views import RESPONSES, STEPS, responses, scratch, table


@query("mcq_lookup", """WITH l AS (SELECT l_orderkey * 10000 + l_partkey % 10000 AS rid, max(CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 60 ELSE l_partkey * 2 END) AS k, max(l_linenumber) * 7 AS want FROM lineitem GROUP BY 1),
r AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 60 ELSE p_partkey END AS k, p_partkey AS part, p_size AS mark FROM part),
j AS (SELECT rid, l.k, want, part, mark, count(part) OVER w AS n, sum(CASE WHEN mark = want THEN 1 ELSE 0 END) OVER w AS hits, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN mark = want THEN 1 ELSE 0 END DESC, part, mark) AS rk FROM l LEFT JOIN r ON l.k = r.k WINDOW w AS (PARTITION BY rid)),
s AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 OR hits = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM j WHERE rk = 1)
SELECT rid, status, CASE WHEN status = 'matched' THEN part END AS part FROM s""")
def mcq_lookup(spark, folder):
    """All of lineitem against all of part. A third of the parts share 20 keys, which grow with the table; half of the other keys have no part."""
    hot = "CASE WHEN {0} % 3 = 0 THEN {0} % 60 ELSE {0} * {1} END"
    left = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 10000 + F.col("l_partkey") % 10000).alias("rid")).agg(F.max(F.expr(hot.format("l_partkey", 2))).alias("k"), (F.max("l_linenumber") * 7).alias("want"))
    right = table(spark, folder, "part").select(F.expr(hot.format("p_partkey", 1)).alias("k"), F.col("p_partkey").alias("part"), F.col("p_size").alias("mark"))
    return J.disambiguated_by_value(left, right, "k", "mark", "want").select("rid", "status", "part")


@query("target_matching", """WITH a AS (SELECT o_orderkey, o_custkey % 5 AS k, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT c_custkey, c_custkey % 5 AS k, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) AS n FROM customer)
SELECT a.k, o_orderkey, c_custkey FROM a JOIN b ON a.k = b.k AND a.n = b.n""")
def target_matching(spark, folder):
    a = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("k"))
    b = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("k"))
    return J.matched_in_order(a, b, "k", "o_orderkey", "c_custkey").select("k", "o_orderkey", "c_custkey")


@query("eval_id_join", """WITH p AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS a, '[eval_id=' || (user_id % 40) || ']' AS prompt FROM events)
SELECT event_id, CAST(n_nationkey AS BIGINT) AS eval_id, n_name AS name FROM p JOIN nation ON n_nationkey = coalesce(a, CAST(regexp_extract(prompt, '(\\d+)', 1) AS BIGINT))""")
def eval_id_join(spark, folder):
    u = F.col("user_id")
    p = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, u).alias("answer_eval_id"), F.concat(F.lit("[eval_id="), (u % 40).cast("string"), F.lit("]")).alias("prompt"))
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("eval_id"), F.col("n_name").alias("name"))
    return J.by_answer_or_prompt(p, n).select("event_id", "eval_id", "name")


@query("pool_fallback", """WITH pools AS (SELECT p_type AS k, count(DISTINCT p_brand) AS n FROM part WHERE p_type NOT LIKE 'ECO%' AND p_type NOT LIKE '%A%' GROUP BY 1), a AS (SELECT count(DISTINCT p_brand) AS n FROM part)
SELECT p_partkey, coalesce(pools.n, a.n) AS n FROM part LEFT JOIN pools ON p_type = k, a""")
def pool_fallback(spark, folder):
    p = table(spark, folder, "part")
    pools = p.where("p_type not like 'ECO%' and p_type not like '%A%'").groupBy(F.col("p_type").alias("k")).agg(F.count_distinct("p_brand").alias("n"))
    pools = pools.unionByName(p.agg(F.lit("all").alias("k"), F.count_distinct("p_brand").alias("n")))
    return J.with_fallback_pool(p.select("p_partkey", F.col("p_type").alias("k")), pools, "k", "n").select("p_partkey", "n")


@query("optionless_rewrite", """WITH v AS (SELECT lower(p_type) AS g, list_sort(list(DISTINCT p_brand)) AS labels FROM part GROUP BY 1)
SELECT p_partkey, p_brand AS correct_label, '<image>' || chr(10) || 'Question: ' || p_name || chr(10) || 'Choose one of [' || array_to_string(labels, ', ') || '] and put it inside <answer></answer>.' AS prompt FROM part JOIN v ON lower(p_type) = g""")
def optionless_rewrite(spark, folder):
    from ..functions import text as X

    out = P.optionless(table(spark, folder, "part"), "p_brand", X.group_key(F.col("p_type")), F.col("p_name"))
    return out.select("p_partkey", "correct_label", "prompt")


@query("chat_messages", """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<image>' || text ELSE text || ' <image>  <image>' END AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS images, CAST(CASE WHEN trim(replace(p, '<image>', '')) = '' THEN 0 ELSE 1 END AS INTEGER) AS texts FROM x""")
def chat_messages(spark, folder):
    t = F.col("text")
    p = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), t)).otherwise(F.concat(t, F.lit(" <image>  <image>")))
    df = table(spark, folder, "conversations").select("conv_id", "turn", P.messages(p).alias("m"))
    return df.select("conv_id", "turn", F.size(F.filter("m", lambda x: x["type"] == "image")).alias("images"), F.size(F.filter("m", lambda x: x["type"] == "text")).alias("texts"))


@query("repair_union_type", """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '["a", "b' || event_id || '"]' WHEN 1 THEN 'null' WHEN 2 THEN '"t' || event_id || '"' WHEN 3 THEN CAST(event_id AS VARCHAR) END AS raw FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a, b' || event_id WHEN 2 THEN 't' || event_id WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE '' END AS text, CASE event_id % 5 WHEN 0 THEN 'list' WHEN 2 THEN 'string' WHEN 3 THEN 'scalar' ELSE 'null' END AS kind FROM x""")
def repair_union_type(spark, folder):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit('["a", "b'), i, F.lit('"]'))).when(k == 1, "null").when(k == 2, F.concat(F.lit('"t'), i, F.lit('"'))).when(k == 3, i)
    text, kind = P.repaired_answer(raw)
    return table(spark, folder, "events").select("event_id", text.alias("text"), kind.alias("kind"))


LINT = """l AS (SELECT conv_id, turn, list_filter([CASE WHEN trim(text) = '' THEN 'prompt_missing' END, CASE WHEN len(string_split_regex(trim(text), '\\s+')) > 200 THEN 'prompt_long' END, CASE WHEN role <> 'user' AND turn % 3 = 0 THEN 'answer_edges' END, CASE WHEN conv_id % 4 = 0 THEN 'id_form' END], lambda x: x IS NOT NULL) AS c FROM conversations)"""


def _lint(spark, folder):
    role = F.when((F.col("role") != "user") & (F.col("turn") % 3 == 0), F.concat(F.col("role"), F.lit(" "))).otherwise(F.col("role"))
    ident = F.concat(F.when(F.col("conv_id") % 4 == 0, "x").otherwise("c"), F.col("conv_id").cast("string"))
    return table(spark, folder, "conversations").withColumn("codes", V.codes(V.row_rules(F.col("text"), role, ident, r"^c\d+$")))


@query("lint_rows", f"WITH {LINT} SELECT conv_id, turn, array_to_string(c, ',') AS codes FROM l")
def lint_rows(spark, folder):
    return _lint(spark, folder).select("conv_id", "turn", F.array_join("codes", ",").alias("codes"))


@query("lint_problems", f"WITH {LINT}, e AS (SELECT conv_id, unnest(c) AS code FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY conv_id) AS rk, count(*) OVER (PARTITION BY code) AS n FROM e) SELECT code, any_value(n) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS examples FROM r WHERE rk <= 3 GROUP BY code")
def lint_problems(spark, folder):
    return M.problems(_lint(spark, folder), "codes", "conv_id", 3)


@query("lint_groups", """WITH g AS (SELECT conv_id, count(*) AS rows, count(DISTINCT role) AS v, count(DISTINCT turn % 3) AS t FROM conversations GROUP BY 1)
SELECT conv_id, rows, array_to_string(list_filter([CASE WHEN rows <> 3 THEN 'group_size' END, CASE WHEN v > 1 THEN 'value_conflict' END, CASE WHEN t < 3 THEN 'variant_missing' END, CASE WHEN t < rows THEN 'variant_repeated' END], lambda x: x IS NOT NULL), ',') AS codes FROM g""")
def lint_groups(spark, folder):
    c = table(spark, folder, "conversations").withColumn("variant", F.col("turn") % 3)
    return V.group_rules(c, "conv_id", "role", "variant", 3).withColumn("codes", F.array_join("codes", ","))


@query("duplicate_values", """WITH d AS (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT h, n, first, min(doc_id) AS second FROM d JOIN documents ON md5(text) = h AND doc_id > first GROUP BY h, n, first""")
def duplicate_values(spark, folder):
    df = table(spark, folder, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id")
    return V.duplicates(df, "h", "doc_id", 2)


@query("log_import", f"""WITH {RESPONSES} SELECT sid, 'p' || sid AS prompt, response AS output, gold AS ground_truth, CASE WHEN sid % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE sid / 2.0 END AS score FROM responses""".replace("CAST('NaN' AS DOUBLE)", "-1.0"))
def log_import(spark, folder):
    sid = F.col("sid").cast("string")
    log = F.concat(F.lit("header\n[prompt] p"), sid, F.lit("\n[output] "), F.col("response"), F.lit("\n[ground_truth] "), F.col("gold"), F.lit("\n[score] "), F.when(F.col("sid") % 3 == 0, "n/a").otherwise((F.col("sid") / 2).cast("string")), F.lit("\n\n"))
    df = responses(spark, folder).select("sid", F.explode(S.parse_log(log)).alias("r"))
    return df.select("sid", "r.prompt", "r.output", "r.ground_truth", F.when(F.isnan("r.score"), -1.0).otherwise(F.col("r.score")).alias("score"))


BATCH = 64  # documents of a batch, by id: batches grow in number with the table, not in size


def _batches(spark, folder):
    return table(spark, folder, "documents").select(F.floor(F.col("doc_id") / BATCH).alias("batch"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("length"))


LENGTHS = f"b AS (SELECT CAST(doc_id // {BATCH} AS BIGINT) AS batch, doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) AS length FROM documents)"


def _summed(parts):
    """Per batch: rows, parts, sum of lengths, and whether the heaviest part exceeds the lightest by no more than the longest row."""
    sums = parts.groupBy("batch", "part").agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.max("length").alias("m"))
    return sums.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("s").alias("total"), (F.max("s") - F.min("s") <= F.max("m")).alias("even"))


@query("kk_partitions", f"WITH {LENGTHS} SELECT batch, count(*) AS n, least(8, count(*)) AS parts, CAST(sum(length) AS BIGINT) AS total, true AS even FROM b GROUP BY batch")
def kk_partitions(spark, folder):
    """What must hold of any even partition; tests compare the parts themselves with the best ones."""
    return _summed(Q.partition(_batches(spark, folder), "batch", "doc_id", "length", 8))


@query("micro_batches", f"WITH {LENGTHS} SELECT batch, count(*) AS n, greatest(1, least(count(*), CAST(ceil(sum(length) / 4000.0) AS BIGINT))) AS parts, CAST(sum(length) AS BIGINT) AS total, true AS even FROM b GROUP BY batch")
def micro_batches(spark, folder):
    return _summed(Q.micro_batches(_batches(spark, folder), "batch", "doc_id", "length", 4000))


@query("part_faults", f"WITH {LENGTHS} SELECT batch FROM b GROUP BY batch HAVING count(*) < 8")
def part_faults(spark, folder):
    """Batches whose parts aren't 0 to 7: those of fewer than eight rows."""
    return Q.check_parts(Q.partition(_batches(spark, folder), "batch", "doc_id", "length", 8), "batch", "part", 8).select("batch")


@query("imbalance_before", f"""WITH {LENGTHS}, o AS (SELECT batch, length, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS at_, count(*) OVER (PARTITION BY batch) AS n FROM b),
s AS (SELECT batch, at_ // greatest(1, n // 8) AS run, CAST(sum(length) AS BIGINT) AS s FROM o GROUP BY 1, 2) SELECT batch, min(s) AS least, max(s) AS most, round(avg(s), 6) AS mean FROM s GROUP BY batch""")
def imbalance_before(spark, folder):
    return Q.imbalance_in_order(_batches(spark, folder), "batch", "doc_id", "length", 8).withColumn("mean", F.round("mean", 6))


def _event_stream(spark, folder):
    return spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet" if not folder.endswith("parquet") else "*").parquet(folder)


@query("stream_task_counts", "SELECT event_type AS task, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_task_counts(spark, folder):
    name = f"stream_task_counts_{uuid.uuid4().hex}"
    counted = O.counts(_event_stream(spark, folder).select(F.col("event_type").alias("task"), "value"), "task")
    counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("task", "n", F.round("mean", 6).alias("mean"))


@query("stream_task_curves", f"""WITH RECURSIVE {STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY step) AS k FROM steps),
e AS (SELECT task, step, k, 0.1 * CAST(correct AS DOUBLE) AS c, 0.1 * CAST(total AS DOUBLE) AS t FROM n WHERE k = 1
 UNION ALL SELECT n.task, n.step, n.k, 0.9 * e.c + 0.1 * n.correct, 0.9 * e.t + 0.1 * n.total FROM e JOIN n ON n.task = e.task AND n.k = e.k + 1),
w AS (SELECT task, step, total, sum(correct) OVER w / sum(total) OVER w AS acc FROM steps WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT task, CAST(step AS BIGINT) AS step, CAST(total AS BIGINT) AS total, round(acc, 6) AS rolling_acc, round(c / t, 6) AS ema FROM w JOIN e USING (task, step)""")
def stream_task_curves(spark, folder):
    """Counts by task and day kept by a stream, and the curves that they give."""
    kept = scratch(spark, "steps")
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    rows = _event_stream(spark, folder).select(F.col("event_type").alias("task"), day.alias("step"), (F.col("value") > 60).alias("correct"))
    O.each_batch(rows, scratch(spark, "stream"), O.step_counts(kept)).awaitTermination()
    return O.task_curves(spark, kept, 0.9, 5).select("task", "step", "total", F.round("rolling_acc", 6).alias("rolling_acc"), F.round("ema", 6).alias("ema"))
