"""Queries over text functions and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as R
from ..functions import text as X
from ..operators import metrics as M
from .registry import query
from .views import RESPONSES, responses, table

# RE2 has no Unicode-aware \s; the tables hold ASCII white space only.
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _collapse(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _alnum(x: str) -> str:
    return _strip(f"regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')")


def _key(x: str) -> str:
    bare = f"regexp_replace({_strip(x)}, '^[\"''`]+|[\"''`]+$', '', 'g')"
    return rf"lower(regexp_replace({_collapse(bare)}, '[\s.,;:]+$', ''))"


@query("text_normalise", f"""SELECT conv_id, turn, {_collapse('text')} AS collapsed, {_alnum('text')} AS alnum, {_key('text')} AS key,
 regexp_replace(regexp_replace(upper(replace({_strip('text')}, 'ß', 'ss')), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS ident, regexp_replace(regexp_replace(lower({_strip('text')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS preview, CASE WHEN {_strip('text')} = '' THEN 0 ELSE len(string_split_regex({_strip('text')}, '\\s+')) END AS words FROM conversations""")
def text_normalise(spark, folder):
    t = F.col("text")
    return table(spark, folder, "conversations").select("conv_id", "turn", X.collapse(t).alias("collapsed"), X.alnum(t).alias("alnum"), X.answer_key(t).alias("key"), X.identifier(t).alias("ident"), X.slug(t).alias("slug"), X.preview(t, 20).alias("preview"), X.token_count(t).alias("words"))


@query("label_clean", rf"""WITH x AS (SELECT p_partkey, ' ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' image. ' WHEN 1 THEN '..' ELSE ' Image' END AS t FROM part)
SELECT p_partkey, {_strip("regexp_replace(" + _strip("regexp_replace(" + _collapse('t') + r", '\.+$', '')") + r", '\s+[iI][mM][aA][gG][eE]$', '')")} AS label FROM x""")
def label_clean(spark, folder):
    k = F.col("p_partkey") % 3
    t = F.concat(F.lit(" "), F.col("p_name"), F.when(k == 0, " image. ").when(k == 1, "..").otherwise(" Image"))
    return table(spark, folder, "part").select("p_partkey", X.clean_label(t).alias("label"))


@query("options", """WITH x AS (SELECT p_partkey, p_brand AS a, p_type AS b, CASE WHEN p_partkey % 2 = 0 THEN 'none' ELSE p_name END AS c, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 5 = 1 THEN upper(p_type) ELSE 'x' END AS gt FROM part)
SELECT p_partkey, CASE WHEN lower(gt) = lower(a) THEN 'A' WHEN lower(gt) = lower(b) THEN 'B' END AS letter, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS n,
 CASE p_partkey % 4 + 1 WHEN 1 THEN 'A' WHEN 2 THEN 'A or B' WHEN 3 THEN 'A, B, or C' ELSE 'A, B, C, or D' END AS letters,
 '<image>' || chr(10) || 'Question: ' || p_partkey || '?' || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE chr(10) || 'C. ' || c END || chr(10) || 'Answer with one letter inside <answer></answer>.' AS prompt FROM x""")
def options(spark, folder):
    k = F.col("p_partkey")
    opts = [F.col("p_brand"), F.col("p_type"), F.when(k % 2 == 0, "none").otherwise(F.col("p_name"))]
    gt = F.when(k % 5 == 0, F.col("p_brand")).when(k % 5 == 1, F.upper("p_type")).otherwise("x")
    return table(spark, folder, "part").select("p_partkey", X.answer_letter(opts, gt).alias("letter"), X.option_count(opts).alias("n"), X.letter_list((k % 4 + 1).cast("int")).alias("letters"), X.choice_prompt(F.concat(k.cast("string"), F.lit("?")), opts).alias("prompt"))


@query("paths", """WITH x AS (SELECT page_id, '/data/img.d/case' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '_slice' || page_id ELSE '' END || '.png' AS p FROM pages)
SELECT page_id, regexp_extract(p, '[^/]*$') AS base, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '') AS stem, 'd::case' || (page_id % 7) AS id, CASE WHEN page_id % 3 = 0 THEN 'slice' ELSE 'stem' END AS source FROM x""")
def paths(spark, folder):
    k = F.col("page_id")
    p = F.concat(F.lit("/data/img.d/case"), (k % 7).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("_slice"), k.cast("string"))).otherwise(""), F.lit(".png"))
    g = X.group_id(F.lit("d"), [F.lit(None).cast("string"), F.lit("")], p)
    return table(spark, folder, "pages").select("page_id", X.basename(p).alias("base"), X.stem(p).alias("stem"), g["id"].alias("id"), g["source"].alias("source"))


# \b stands beside letters and digits; the responses hold nothing else that would differ between engines.
SPAN = r"CASE WHEN regexp_matches(response, '(?is)<answer>(.*?)</answer>') THEN regexp_replace(regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(response, '^\s+|\s+$', '', 'g') END"
PARSED = rf"""{RESPONSES}, sp AS (SELECT *, {SPAN} AS span FROM responses),
parsed AS (SELECT *, coalesce(nullif(regexp_extract(upper(span), '\b([A-Z])\b', 1), ''), nullif(regexp_extract(upper(span), 'ANSWER\s*[:=]\s*([A-Z])\b', 1), ''), nullif(regexp_extract(upper(span), '([A-Z])', 1), '')) AS letter,
 list_sort(list_distinct(regexp_extract_all(upper(span), '\b([A-Z])\b', 1))) AS found,
 CASE WHEN regexp_matches(lower(span), '\bsame\b') AND NOT regexp_matches(lower(span), '\bdifferent\b') THEN 'same' WHEN regexp_matches(lower(span), '\bdifferent\b') AND NOT regexp_matches(lower(span), '\bsame\b') THEN 'different' END AS sd,
 CASE WHEN length(gold) = 1 THEN 'letter' WHEN length(gold) = 3 THEN 'pair' WHEN gold IN ('same', 'different') THEN 'same_different' ELSE 'unknown' END AS kind FROM sp),
picked AS (SELECT *, CASE kind WHEN 'letter' THEN letter WHEN 'pair' THEN CASE WHEN len(found) = 2 THEN found[1] || ' ' || found[2] END WHEN 'same_different' THEN sd END AS pred,
 CASE kind WHEN 'pair' THEN CASE WHEN substr(gold, 1, 1) < substr(gold, 3, 1) THEN gold ELSE substr(gold, 3, 1) || ' ' || substr(gold, 1, 1) END ELSE gold END AS want FROM parsed)"""


@query("extract_answers", f"WITH {PARSED} SELECT sid, span, letter, CASE WHEN len(found) = 2 THEN found[1] || ' ' || found[2] END AS pair, sd, kind FROM picked")
def extract_answers(spark, folder):
    r = F.col("response")
    return responses(spark, folder).select("sid", X.answer_span(r).alias("span"), X.single_letter(r).alias("letter"), X.letter_pair(r).alias("pair"), X.same_different(r).alias("sd"), X.answer_kind(F.col("gold")).alias("kind"))


@query("score_discrete", f"WITH {PARSED} SELECT sid, CASE WHEN pred IS NULL THEN -0.5 WHEN pred = want THEN 2.0 ELSE -1.5 END::DOUBLE AS overall, CASE WHEN pred = want THEN 1.0 ELSE 0.0 END::DOUBLE AS acc FROM picked")
def score_discrete(spark, folder):
    return responses(spark, folder).select("sid", R.score("discrete", F.col("response"), F.col("gold")).alias("s")).select("sid", "s.overall", "s.acc")


@query("score_task_metrics", f"""WITH {PARSED} SELECT task, count(*) AS total, CAST(sum(CASE WHEN pred = want THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(CASE WHEN pred = want THEN 1.0 ELSE 0.0 END), 6) AS acc FROM picked GROUP BY task
UNION ALL SELECT 'overall', count(*), CAST(sum(CASE WHEN pred = want THEN 1 ELSE 0 END) AS BIGINT), round(avg(CASE WHEN pred = want THEN 1.0 ELSE 0.0 END), 6) FROM picked""")
def score_task_metrics(spark, folder):
    df = responses(spark, folder).withColumn("s", R.score("discrete", F.col("response"), F.col("gold"))).select("task", F.col("s.acc").cast("int").alias("correct"))
    return M.task_accuracy(df).select("task", "total", "correct", F.round("acc", 6).alias("acc"))


@query("score_direct", rf"""WITH {RESPONSES}, sp AS (SELECT *, CASE WHEN regexp_matches(response, '(?is)<answer>(.*?)</answer>') THEN regexp_replace(regexp_extract(response, '(?is)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') WHEN regexp_matches(response, '(?i)answer\s*[:=]') THEN regexp_replace(regexp_extract(response, '(?i)answer\s*[:=]\s*(.*)', 1), '^\s+|\s+$', '', 'g') ELSE trim(response) END AS p FROM responses),
t AS (SELECT *, list_filter(regexp_extract_all(p, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z]$')) AS pl, list_filter(regexp_extract_all(gold, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z]$')) AS gl FROM sp)
SELECT sid, CAST(coalesce(CASE WHEN p = '' THEN false WHEN gold IN ('same', 'different') THEN lower(p) = gold WHEN len(gl) = 1 THEN upper(pl[1]) = gl[1] WHEN len(gl) = 2 THEN list_sort(list_transform(pl[1:2], lambda x: upper(x))) = list_sort(gl) ELSE lower(p) = gold END, false) AS DOUBLE) AS overall FROM t""")
def score_direct(spark, folder):
    return responses(spark, folder).select("sid", R.score("direct", F.col("response"), F.col("gold"))["overall"].alias("overall"))


CONF = r"""conf AS (SELECT *, regexp_matches(lower(response), 'it is a|not sure') AS amb,
 coalesce(nullif(regexp_extract(lower(response), '<answer>\s*(malignant|benign|unsure)\s*</answer>', 1), ''), nullif(regexp_extract(lower(response), 'answer\s*[:=]\s*(malignant|benign|unsure)', 1), ''), 'unknown') AS given,
 TRY_CAST(coalesce(nullif(regexp_extract(lower(response), '<confidence>\s*([0-9]*\.?[0-9]+)\s*</confidence>', 1), ''), nullif(regexp_extract(lower(response), 'confidence\s*[:=]\s*([0-9]*\.?[0-9]+)', 1), '')) AS DOUBLE) AS c FROM responses),
sure AS (SELECT *, amb OR given IN ('unsure', 'unknown') AS unsure, CASE WHEN c IS NULL THEN 0.0 ELSE least(CASE WHEN c > 1 THEN c / 100 ELSE c END, 1.0) END AS k FROM conf)"""


@query("score_confidence", f"""WITH {RESPONSES}, {CONF} SELECT sid, round(CASE WHEN unsure THEN 0.0 WHEN given = gold THEN 0.5 + 0.5 * k - 0.1 ELSE -2.0 * k - 0.1 END, 6) AS overall, round(CASE WHEN unsure THEN 0.0 ELSE k END, 6) AS confidence FROM sure""")
def score_confidence(spark, folder):
    s = R.score("confidence", F.col("response"), F.col("gold"), ["it is a", "not sure"], ["malignant", "benign"])
    return responses(spark, folder).select("sid", s.alias("s")).select("sid", F.round("s.overall", 6).alias("overall"), F.round("s.confidence", 6).alias("confidence"))


@query("confidence_coverage", f"""WITH {RESPONSES}, {CONF} SELECT round(avg(CASE WHEN unsure THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(1 - avg(CASE WHEN unsure THEN 0.0 ELSE 1.0 END), 6) AS unsure_rate,
 round(sum(CASE WHEN NOT unsure AND given = gold THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN unsure THEN 0.0 ELSE 1.0 END), 6) AS selective_acc FROM sure""")
def confidence_coverage(spark, folder):
    s = R.score("confidence", F.col("response"), F.col("gold"), ["it is a", "not sure"], ["malignant", "benign"])
    out = M.coverage(responses(spark, folder).select(s.alias("s")).select("s.*"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


LISTS = """l AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ,]', '', 'g')), '[ ,]+'), lambda x: x <> ''))[1:6] AS a FROM conversations),
lp AS (SELECT a.conv_id, a.turn, a.a AS p, b.a AS g FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("score_list", """WITH w AS (SELECT o_orderkey, list_distinct(list_transform([o_orderkey % 5, o_orderkey % 7, o_orderkey % 3, o_orderkey % 11], lambda x: 'i' || x)) AS p, list_distinct(list_transform([o_custkey % 5, o_custkey % 7, o_custkey % 3], lambda x: 'i' || x)) AS g FROM orders),
n AS (SELECT *, len(list_intersect(p, g)) AS b FROM w) SELECT o_orderkey, round(2.0 * b / (len(p) + len(g)), 6) AS f1, round(b / len(p), 6) AS precision, round(b / len(g), 6) AS recall, round(b / (len(p) + len(g) - b), 6) AS jaccard FROM n""")
def score_list(spark, folder):
    name = lambda c, ks: F.array(*[F.concat(F.lit("i"), (F.col(c) % k).cast("string")) for k in ks])
    df = table(spark, folder, "orders").select("o_orderkey", name("o_orderkey", (5, 7, 3, 11)).alias("p"), name("o_custkey", (5, 7, 3)).alias("g"))
    return df.select("o_orderkey", *[F.round(R.list_score(F.col("p"), F.col("g"), m), 6).alias(m) for m in ("f1", "precision", "recall", "jaccard")])


@query("score_offline", rf"""WITH {RESPONSES}, sp AS (SELECT *, {SPAN} AS span FROM responses), k AS (SELECT *, {_key('span')} AS sk, {_key('gold')} AS gk FROM sp)
SELECT sid, CASE WHEN sk = gk AND sk <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS overall FROM k""")
def score_offline(spark, folder):
    s = R.score("offline", F.col("response"), F.col("gold"), F.lit("text"), {"benign": "Benign"}, F.array().cast("array<string>"))
    return responses(spark, folder).select("sid", s["overall"].alias("overall"))


@query("score_overlong", "SELECT doc_id, round(CASE WHEN n_chars - 3000 <= 0 THEN 0.0 WHEN n_chars <= 4000 THEN -(n_chars - 3000) / 1000.0 ELSE -1.0 END, 6)::DOUBLE + 0.0 AS penalty FROM documents")
def score_overlong(spark, folder):
    return table(spark, folder, "documents").select("doc_id", (F.round(X.overlong_penalty(F.col("n_chars"), 4000, 1000), 6) + 0.0).alias("penalty"))


ALIAS = {"economy": "Economy", "eco": "Economy", "standard": "Standard", "promo": "Promo", "small": "Small"}


@query("canonical_label", f"""WITH s AS (SELECT p_partkey, {_alnum("p_type || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'eco' WHEN 1 THEN 'promo' ELSE '' END")} AS s FROM part),
a AS (SELECT unnest(['economy', 'eco', 'standard', 'promo', 'small']) AS k, unnest(['Economy', 'Economy', 'Standard', 'Promo', 'Small']) AS v),
m AS (SELECT p_partkey, max(CASE WHEN s = k THEN v END) AS exact, list_distinct(list(v) FILTER (contains(' ' || s || ' ', ' ' || k || ' '))) AS within FROM s, a GROUP BY 1)
SELECT p_partkey, coalesce(exact, CASE WHEN len(within) = 1 THEN within[1] END) AS label FROM m""")
def canonical_label(spark, folder):
    k = F.col("p_partkey") % 4
    t = F.concat(F.col("p_type"), F.lit(" "), F.when(k == 0, "eco").when(k == 1, "promo").otherwise(""))
    return table(spark, folder, "part").select("p_partkey", X.canonical_label(t, ALIAS).alias("label"))


@query("line_numbers", "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, i AS line, 'L' || lpad(CAST(i AS VARCHAR), 4, '0') || ' ' || l[i] AS text FROM (SELECT doc_id, l, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS i FROM x)")
def line_numbers(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(X.numbered_lines(F.col("text")))).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))
