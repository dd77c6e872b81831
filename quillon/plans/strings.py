"""Queries over the text functions that no other query reaches. Texts are put together from columns, so the SQL knows the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query
from .views import table

# SQL that both engines read, over events: what the texts are put together from.
_WORD = "CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE.' ELSE 'maybe' END"
_LIST = "'\"a1\", b2;' || event_type || chr(10) || 'A1, x' || CAST(event_id % 3 AS STRING)"
_NUMBER = "CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN '2.5' WHEN 2 THEN 'n1' ELSE 'nan' END"
_TOKENS = "CASE WHEN event_id % 2 = 0 THEN 'b) and A, not b' ELSE 'none_of ' || event_type END"


@query("prompt_parts", f"""SELECT p_partkey, 'the ' || p_name AS question, p_brand || '|' || p_type AS listed, list_aggregate(list_transform(range(p_size % 3 + 1), lambda i: 'Image ' || chr(CAST(65 + i AS INTEGER)) || ': <image>'), 'string_agg', chr(10)) AS block,
 'red ' || lower(replace(p_brand, '#', ' ')) AS words, CASE p_size % 3 WHEN 0 THEN 'right' WHEN 1 THEN '(e) right' ELSE 'b' END AS bare, lower(p_brand) || ': 1' AS items FROM part""")
def prompt_parts(spark, folder):
    p = table(spark, folder, "part")
    prompt = F.concat(F.lit("Look.\n  QUESTION :  the "), F.col("p_name"), F.lit(" \nChoose one of [ "), F.col("p_brand"), F.lit(" , "), F.col("p_type"), F.lit(","), F.col("p_brand"), F.lit(" ,] or [none]"))
    noisy = F.concat(F.lit("<b>Red</b> the_image "), F.col("p_brand"))
    option = F.expr("CASE p_size % 3 WHEN 0 THEN 'Option (B): right' WHEN 1 THEN '(e) right' ELSE 'b' END")
    label = F.element_at(X.label_map(F.concat(F.lit("a: no\nA: x\n B. "), F.lower("p_brand"), F.lit(": 1 \nA: y\nFinal: C"))), "B")
    return p.select("p_partkey", X.question_of(prompt).alias("question"), F.array_join(X.bracket_list(prompt), "|").alias("listed"), X.image_block((F.col("p_size") % 3 + 1)).alias("block"), X.without_words(noisy, ["the", "image"]).alias("words"), X.strip_option_prefix(option).alias("bare"), label.alias("items"))


@query("answer_parts", """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'no' WHEN 3 THEN NULL ELSE 'yes' END AS flag, CASE event_type WHEN 'a1' THEN 'a1|b2' ELSE 'a1|b2|' || event_type END || '|x' || (event_id % 3) AS items,
 CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN 2.5 END AS number, CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE 'none_of|' || event_type END AS tokens,
 CASE WHEN event_id % 12 < 3 THEN CAST(event_id % 12 AS VARCHAR) END AS digit, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) END AS spelled, event_id % 3 = 0 AS every, event_id % 6 IN (0, 2, 3, 4) AS some,
 CASE event_id % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'text' WHEN 2 THEN 'list' WHEN 3 THEN 'text' ELSE 'label' END AS kind FROM events""")
def answer_parts(spark, folder):
    e = table(spark, folder, "events")
    options = F.array(F.lit("CLICK"), F.lit("VIEW"))
    both = F.concat(F.when(F.col("event_id") % 2 == 0, "Alpha ").otherwise(""), F.when(F.col("event_id") % 3 == 0, "ALPHA beta").otherwise(""))
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN ' Boolean' WHEN 1 THEN 'short_text' WHEN 2 THEN 'short_list ' WHEN 3 THEN '' ELSE 'Label' END")
    digit = F.concat(F.lit("so <answer>no "), (F.col("event_id") % 12).cast("string"), F.lit("!</answer> 1"))
    return e.select("event_id", X.yes_no(F.expr(_WORD)).alias("flag"), F.array_join(X.list_items(F.expr(_LIST)), "|").alias("items"), X.as_float(F.expr(_NUMBER)).alias("number"), F.array_join(X.answer_tokens(F.expr(_TOKENS)), "|").alias("tokens"), X.digit_choice(digit).alias("digit"),
                    X.option_lookup(F.concat(F.lit(" '"), F.col("event_type"), F.lit("' ")), options).alias("spelled"),
                    X.contains_all(both, F.array(F.lit("alpha"), F.lit("Beta"))).alias("every"), X.contains_any(both, F.array(F.lit("ALPHA"))).alias("some"), X.answer_type(kind).alias("kind"))


@query("unique_in_order", """SELECT event_id, CASE event_type WHEN 'click' THEN 'Click|b' WHEN 'b' THEN 'Click|b' ELSE 'Click|b|' || event_type END AS kept, 'CLICK|B' AS ordered FROM events""")
def unique_in_order(spark, folder):
    e = table(spark, folder, "events")
    items = F.array(F.lit("Click"), F.lit(" b."), F.col("event_type"), F.lit("'click'"), F.lit("B"))
    return e.select("event_id", F.array_join(F.transform(X.stable_unique(items), lambda x: F.replace(F.trim(x), F.lit("."), F.lit(""))), "|").alias("kept"), F.array_join(X.by_option_order(F.reverse(items), F.array(F.lit("CLICK"), F.lit("B"), F.lit("none of them"))), "|").alias("ordered"))


@query("math_parts", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'frac{1}{' || event_id % 7 || '}' WHEN 2 THEN 'x' || event_id ELSE 'sqrt{2}' END AS answer,
 CASE event_id % 3 WHEN 0 THEN 'a{b}' || event_id WHEN 1 THEN 'last' END AS boxed, CAST(event_id % 3 = 0 AS DOUBLE) AS formed, CAST(least(0.2, 0.1 * (event_id % 4)) AS DOUBLE) AS bonus, CAST(0.5 * CAST(event_id % 2 = 0 AS INTEGER) + 0.25 * CAST(event_id % 3 = 0 AS INTEGER) AS DOUBLE) AS hits,
 CASE WHEN event_id % 2 = 0 THEN '{"a": {"b": ' || event_id || '}}' END AS object FROM events""")
def math_parts(spark, folder):
    e = table(spark, folder, "events")
    n = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x = y = "), F.format_string("%,d", "event_id"), F.lit(" units"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(r"\boxed{\text{frac1"), (F.col("event_id") % 7).cast("string"), F.lit("}}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("k=$x"), n, F.lit("$"))).otherwise(F.lit("sqrt2"))
    boxed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>t</think> so \\boxed{a{b}"), n, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit("\\boxed{first} \\boxed{last}")).otherwise(F.lit("none"))
    words = F.array_join(F.slice(F.array(F.lit("Alpha"), F.lit("beta"), F.lit("GAMMA")), F.lit(1), (F.col("event_id") % 4).cast("int")), " ")
    hits = F.concat(F.when(F.col("event_id") % 2 == 0, "Margin ").otherwise(""), F.when(F.col("event_id") % 3 == 0, "ECHO").otherwise(""))
    text = F.concat(F.lit('is {"a": {"b": '), n, F.when(F.col("event_id") % 2 == 0, "}} ok").otherwise("} ok"))
    return e.select("event_id", X.math_answer(raw, {"units": ""}, [" "]).alias("answer"), X.boxed(boxed).alias("boxed"), X.well_formed(boxed).alias("formed"), F.round(X.keyword_bonus(words, F.array(F.lit("alpha"), F.lit("Beta"), F.lit("gamma")), 0.1, 0.2), 6).alias("bonus"), F.round(X.weighted_hits(hits, {"margin": 0.5, "echo": 0.25}), 6).alias("hits"), X.json_object(text).alias("object"))


@query("resized", """WITH s AS (SELECT *, CASE WHEN w * h > 40000 THEN sqrt(40000.0 / (w * h)) WHEN w * h < 900 THEN sqrt(900.0 / (w * h)) ELSE 1.0 END AS f FROM (SELECT l_orderkey, l_linenumber, l_partkey % 977 + 3 AS w, l_suppkey % 311 + 5 AS h FROM lineitem))
SELECT l_orderkey, l_linenumber, CAST(trunc(w * f) AS INTEGER) AS width, CAST(trunc(h * f) AS INTEGER) AS height FROM s""")
def resized(spark, folder):
    size = X.resized(F.col("l_partkey") % 977 + 3, F.col("l_suppkey") % 311 + 5, 900, 40000)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.width", "s.height")


@query("canonical_names", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'melanoma' WHEN 1 THEN 'nevus' WHEN 2 THEN 'keratosis' WHEN 3 THEN 'melanoma' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'mal' || 'ignant' WHEN p_partkey % 3 = 1 THEN 'x' || p_partkey END AS shown FROM part""")
def canonical_names(spark, folder):
    spelled = F.expr("CASE p_size % 5 WHEN 0 THEN 'Mel.' WHEN 1 THEN 'N-V image' WHEN 2 THEN 'a Keratosis, here' WHEN 3 THEN 'MELANOMA' ELSE 'zzz' END")
    name = X.canonical_label(spelled, {"mel": "melanoma", "n v": "nevus"}, F.array(F.lit("melanoma"), F.lit("nevus"), F.lit("keratosis")))
    raw = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'so <ANSWER> malignant </answer> <answer>no</answer>' WHEN p_partkey % 3 = 1 THEN '<answer>x' || p_partkey || '</answer>' ELSE 'none' END")
    return table(spark, folder, "part").select("p_partkey", name.alias("name"), X.tagged(raw).alias("shown"))
