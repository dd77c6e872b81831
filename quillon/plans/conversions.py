"""Queries over row conversions, schedules and comparative samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert as C
from .registry import query
from .views import table


@query("offline_rows", """SELECT p_partkey, 'What is ' || p_name || ' of [' || p_brand || ', ' || p_type || ']?' AS prompt, 'img/' || p_partkey AS image, p_brand || '|' || p_type AS labels, p_brand AS answer FROM part""")
def offline_rows(spark, folder):
    problem = F.expr("'What is ' || p_name || ' of [' || p_brand || ', ' || p_type || ']?' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || ' Please answer directly, with no reasoning.' ELSE '' END")
    row = C.offline_row(problem, F.expr("' ' || p_brand || '  '"), F.expr("'img/' || CAST(p_partkey AS STRING)"))
    r = table(spark, folder, "part").select("p_partkey", row.alias("r"))
    return r.select("p_partkey", "r.prompt", F.get("r.images", F.lit(0)).alias("image"), F.array_join("r.answer.candidate_labels", "|").alias("labels"), F.col("r.answer.correct_answer").alias("answer"))


@query("base_rows", "SELECT 'dtd-' || p_partkey AS question_id, 'classification' AS question_type, p_brand AS gt_answer, CAST(NULL AS VARCHAR) AS option_A FROM part")
def base_rows(spark, folder):
    row = C.base_row(F.col("p_partkey"), F.expr("p_brand || ' Image.'"), F.col("p_name"), "dtd")
    return table(spark, folder, "part").select(row.alias("r")).select("r.question_id", "r.question_type", "r.gt_answer", "r.option_A")


@query("answer_structs", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '') AS label, CASE o_orderkey % 3 WHEN 0 THEN '/abs/' || o_orderkey WHEN 1 THEN 'root/' || o_orderkey ELSE '' END AS images FROM orders")
def answer_structs(spark, folder):
    image = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '/abs/' || CAST(o_orderkey AS STRING) WHEN 1 THEN CAST(o_orderkey AS STRING) END")
    row = C.answer_struct(F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END"), image, "root/")
    r = table(spark, folder, "orders").select("o_orderkey", row.alias("r"))
    return r.select("o_orderkey", F.col("r.answer.label").alias("label"), F.array_join("r.images", "|").alias("images"))


@query("fold_samples", "SELECT event_id, event_id || '.png' AS plain, 'fold/' || event_id || '.png' AS prefixed, lower(event_type) AS label FROM events")
def fold_samples(spark, folder):
    path = F.expr("CASE WHEN event_id % 2 = 0 THEN 'a/b/' ELSE '' END || CAST(event_id AS STRING) || '.png'")
    label = F.expr("'  ' || upper(event_type)")
    e = table(spark, folder, "events").select("event_id", C.fold_sample(path, label).alias("p"), C.fold_sample(path, label, "fold/").alias("q"))
    return e.select("event_id", F.col("p.image").alias("plain"), F.col("q.image").alias("prefixed"), "q.label")


@query("nested_values", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'v' || event_id ELSE 'none' END AS value FROM events")
def nested_values(spark, folder):
    document = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"answer": {"task": {"type": "v' || CAST(event_id AS STRING) || '"}}}' WHEN 1 THEN '{"answer": "x"}' ELSE 'no json' END""")
    return table(spark, folder, "events").select("event_id", C.nested(document, "answer.task.type", "none").alias("value"))


@query("listed_files", "SELECT l_orderkey, l_linenumber, p_partkey IS NULL AS missing FROM lineitem LEFT JOIN part ON l_partkey * 2 = p_partkey")
def listed_files(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("path"))
    listing = table(spark, folder, "part").select(F.col("p_partkey").alias("path"))
    return C.with_listing(rows, listing, "path", drop=False).select("l_orderkey", "l_linenumber", "missing")


@query("listed_files_only", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey * 2 = p_partkey")
def listed_files_only(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("path"))
    listing = table(spark, folder, "part").select(F.col("p_partkey").alias("path"))
    return C.with_listing(rows, listing, "path", drop=True).select("l_orderkey", "l_linenumber")


@query("gated_rewrite", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'new' ELSE event_type END AS value FROM events")
def gated_rewrite(spark, folder):
    t = F.col("event_type")
    return table(spark, folder, "events").select("event_id", C.rewritten_where(t, "click", t, F.lit("new")).alias("value"))


@query("named_labels", "SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON s_nationkey + 3 = n_nationkey")
def named_labels(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_nationkey") + 3).alias("label"))
    return C.labelled(s, table(spark, folder, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name")), "label", "name").select("s_suppkey", "name")


@query("fuzzy_letters", """WITH p AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE 'C' END AS letter FROM part) SELECT p_partkey, letter FROM p""")
def fuzzy_letters(spark, folder):
    truth = F.expr("CASE p_size % 4 WHEN 0 THEN 'Malignant image.' WHEN 1 THEN ' BENIGN ' WHEN 2 THEN 'neither' ELSE p_brand END")
    options = [F.lit("benign"), F.lit("malignant tumour"), F.col("p_brand"), F.lit(None).cast("string")]
    return table(spark, folder, "part").select("p_partkey", C.fuzzy_letter(options, truth).alias("letter"))


@query("rebuilt_questions", """WITH c AS (SELECT ps, min(p_partkey) AS first, count(*) AS n FROM (SELECT p_partkey // 2 AS ps, p_partkey FROM part) GROUP BY ps)
SELECT o.p_partkey AS rid, CASE WHEN n IS NULL THEN 'missing' ELSE 'matched' END AS status, CASE WHEN n IS NOT NULL THEN 'A' END AS answer_id FROM part o LEFT JOIN c ON o.p_partkey - 5 = c.ps""")
def rebuilt_questions(spark, folder):
    """Few-shot rows look for corpus questions by a key that two parts share; the wanted mark decides between them."""
    few = table(spark, folder, "part").select(F.col("p_partkey").alias("rid"), (F.col("p_partkey") - 5).alias("k"), F.lit(0).cast("long").alias("want"))
    corpus = table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("k"), F.col("p_partkey").alias("part"), F.pmod("p_partkey", F.lit(2)).alias("mark"), F.col("p_brand").alias("option_A"), F.lit("no").alias("option_B"), F.col("p_brand").alias("truth"))
    return C.rebuilt(few, corpus, "k", "mark", "want", ["option_A", "option_B"], "truth").select("rid", "status", "answer_id")


_SCOPES, _KINDS, _LABELS = C.quota_cycle({"general": 2, "class": 3}, ["general", "class"]), C.quota_cycle({"boolean": 1, "text": 2, " ": 4}, ["boolean", " ", "text"]), ["a", "b", "c", "d"]


@query("target_schedule", """WITH s AS (SELECT o_orderkey AS batch, slot, (o_orderkey + slot) % 5 >= 2 AS own, (o_orderkey + slot) % 3 AS k FROM (SELECT o_orderkey, unnest(range(7)) AS slot FROM orders)),
turn AS (SELECT o, count(*) FILTER ((o + i) % 5 >= 2) AS n FROM (SELECT unnest(range(5)) AS o), (SELECT unnest(range(7)) AS i) GROUP BY o), base AS (SELECT b.o, coalesce(sum(t.n), 0) AS before FROM turn b LEFT JOIN turn t ON t.o < b.o GROUP BY b.o),
c AS (SELECT s.*, (batch // 5) * (SELECT sum(n) FROM turn) + before + sum(CAST(own AS INTEGER)) OVER (PARTITION BY batch ORDER BY slot) - 1 AS place FROM s JOIN base ON batch % 5 = o)
SELECT batch, CAST(slot AS INTEGER) AS slot, CASE WHEN own THEN 'class' ELSE 'general' END AS scope, CASE WHEN k = 0 THEN 'boolean' ELSE 'text' END AS answer_type, CASE WHEN own THEN chr(CAST(97 + place % 4 AS INTEGER)) END AS label FROM c""")
def target_schedule(spark, folder):
    batches = table(spark, folder, "orders").select(F.col("o_orderkey").alias("batch"))
    return C.schedule(batches, _SCOPES, _KINDS, _LABELS, 7)


@query("block_ranges", "WITH e AS (SELECT event_id, user_id + 1 AS n, event_id % 7 + 1 AS k, event_id % 3 % (event_id % 7 + 1) AS i FROM events) SELECT event_id, CAST(i * ((n + k - 1) // k) + 1 AS BIGINT) AS first, CAST(least((i + 1) * ((n + k - 1) // k), n) AS BIGINT) AS last FROM e")
def block_ranges(spark, folder):
    n, k = F.col("user_id") + 1, F.col("event_id") % 7 + 1
    r = table(spark, folder, "events").select("event_id", C.block_range(n, k, F.col("event_id") % 3 % k).alias("r"))
    return r.select("event_id", F.col("r.begin").cast("long").alias("first"), F.col("r.end").cast("long").alias("last"))


@query("single_image_tasks", "SELECT p_partkey, '<image>' || chr(10) || 'Which brand is ' || p_name || '?' AS prompt, p_brand AS answer FROM part")
def single_image_tasks(spark, folder):
    t = C.single_image(F.expr("'  Which  brand is ' || p_name || '? '"), F.col("p_type"), F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.prompt", F.col("t.answer.correct_answer").alias("answer"))


_HASH = "CAST(('0x' || substr(md5('s|{what}|' || i || '|' || {place}), 1, 8)) AS BIGINT)"


@query("comparative_samples", f"""WITH r AS (SELECT o_orderkey AS i, o_orderkey % 3 AS t, o_custkey AS c FROM orders),
s AS (SELECT i, t, c, k, CASE WHEN k = 0 THEN t ELSE list_extract(list_filter([0, 1, 2], lambda x: x <> t), CAST((k - 1) % 2 + 1 AS INTEGER)) END AS cls FROM (SELECT *, unnest(range(4)) AS k FROM r)),
n AS (SELECT *, CASE cls WHEN 0 THEN 1 WHEN 1 THEN c % 3 ELSE 5 END AS size, {_HASH.format(what='image', place='k')} AS d, {_HASH.format(what='order', place='k')} AS o FROM s),
g AS (SELECT i, t, k, cls || '-' || (d % size) AS image, o FROM n WHERE size > 0),
p AS (SELECT i, t, string_agg(image, '|' ORDER BY o, k) AS images FROM g GROUP BY i, t), h AS (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY o, k) AS rk FROM g)
SELECT p.i, ['x', 'y', 'z'][t + 1] AS target_class, CASE WHEN rk IS NOT NULL THEN images END AS images, chr(CAST(64 + rk AS INTEGER)) AS correct_answer FROM p LEFT JOIN h ON p.i = h.i AND h.k = 0""")
def comparative_samples(spark, folder):
    pool = lambda c, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda j: F.concat(F.lit(f"{c}-"), j.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("i"), pool(0, F.lit(1)).alias("p0"), pool(1, (F.col("o_custkey") % 3).cast("int")).alias("p1"), pool(2, F.lit(5)).alias("p2"))
    return C.comparative(rows, {"x": "p0", "y": "p1", "z": "p2"}, ["x", "y", "z"], 4, "s").select("i", "target_class", F.array_join("images", "|").alias("images"), "correct_answer")


@query("dedupe_json", "SELECT min(event_id) AS event_id FROM events WHERE event_id % 11 > 0 GROUP BY user_id % 50, event_type UNION ALL SELECT event_id FROM events WHERE event_id % 11 = 0")
def dedupe_json(spark, folder):
    key = F.expr("""CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_id % 2 = 0 THEN '{"u": ' || CAST(user_id % 50 AS STRING) || ', "t": "' || event_type || '"}' ELSE '{"t":"' || event_type || '","u":' || CAST(user_id % 50 AS STRING) || '}' END END""")
    return C.dedupe_json(table(spark, folder, "events").select("event_id", key.alias("k")), "k", "event_id").select("event_id")
