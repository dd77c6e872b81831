"""Queries over the scorers that no other query reaches. Responses are put together from columns, so the SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as R
from ..operators import groupstats as G
from .registry import query
from .views import TOKENS, table, tokens

# SQL that both engines read, over events.
_TRUTH = "CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'other' END"
_GOLD = "CASE user_id % 3 WHEN 0 THEN 'melanoma' WHEN 1 THEN 'nevus' ELSE 'keratosis' END"
_SAID = "CASE event_id % 5 WHEN 0 THEN 'Melanoma image' WHEN 1 THEN 'NV' WHEN 2 THEN 'the keratosis here' WHEN 3 THEN 'keratosis' ELSE 'zzz' END"
_MEANT = "CASE event_id % 5 WHEN 0 THEN 'melanoma' WHEN 1 THEN 'nevus' WHEN 4 THEN NULL ELSE 'keratosis' END"
_REWARD = f"CASE WHEN {{p}} IS NULL THEN CAST({R.UNREADABLE} AS DOUBLE) WHEN {{p}} = {{g}} THEN CAST({R.RIGHT} AS DOUBLE) ELSE CAST({R.WRONG} AS DOUBLE) END"
_ALIASES = {"nv": "nevus", "melanoma mal": "melanoma"}


def _events(spark, folder):
    return table(spark, folder, "events")


def _names():
    return F.array(F.lit("melanoma"), F.lit("nevus"), F.lit("keratosis"))


@query("score_choice", "SELECT event_id, CAST(event_id % 4 = user_id % 3 AS DOUBLE) AS overall FROM events")
def score_choice(spark, folder):
    s = R.score("choice", F.expr("'so <answer>' || CAST(event_id % 4 AS STRING) || '</answer> 1'"), F.expr("' ' || CAST(user_id % 3 AS STRING)"))
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"))


@query("score_equality", f"SELECT event_id, round(CAST(0.8 * CAST({_TRUTH} = event_type AS INTEGER) + 0.2 * CAST(event_id % 3 = 0 AS INTEGER) AS DOUBLE), 6) AS overall, CAST({_TRUTH} = event_type AS DOUBLE) AS accuracy, CAST(event_id % 3 = 0 AS DOUBLE) AS format FROM events")
def score_equality(spark, folder):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN '<answer> ' || upper(event_type) || '. </answer>' WHEN 1 THEN 'My Answer : ' || event_type || ' ;' ELSE ' ' || event_type || '  ' END")
    s = R.score("equality", text, F.expr(_TRUTH), format_weight=0.2)
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"), s["accuracy"].alias("accuracy"), s["format"].alias("format"))


@query("score_tail", f"""WITH e AS (SELECT *, event_id % 120 AS n, {_TRUTH} = event_type AND event_id % 5 > 0 AS hit FROM events)
SELECT event_id, round(CASE WHEN hit THEN 1.0 ELSE -1.0 END + CASE WHEN n <= 80 THEN 0.0 WHEN n <= 100 THEN -(n - 80) / 20.0 ELSE -1.0 END, 6) AS overall, CAST(hit AS DOUBLE) AS accuracy FROM e""")
def score_tail(spark, folder):
    # in a fifth of the rows the answer stands before the last 300 characters
    text = F.expr("'Answer: none' || chr(10) || 'answer : ' || event_type || chr(10) || CASE WHEN event_id % 5 = 0 THEN repeat('x ', 200) ELSE 'end' END")
    s = R.score("tail", text, F.expr(_TRUTH), F.col("event_id") % 120, most=100, buffer=20)
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"), s["accuracy"].alias("accuracy"))


@query("score_keywords", f"SELECT event_id, round(CAST(CAST({_TRUTH} = event_type AS INTEGER) + 0.1 * (event_id % 4) AS DOUBLE), 6) AS overall, CAST({_TRUTH} = event_type AS DOUBLE) AS acc FROM events")
def score_keywords(spark, folder):
    text = F.expr("'<answer>' || event_type || '</answer>' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Alpha' WHEN 2 THEN ' beta ALPHA' ELSE ' alphabeta gamma' END")
    s = R.score("keywords", text, F.expr(_TRUTH), F.array(F.lit("alpha"), F.lit("Beta"), F.lit("gamma")))
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"), s["acc"].alias("acc"))


@query("score_math", """WITH e AS (SELECT event_id, event_id % 3 < 2 AND event_id % 5 = user_id % 5 AS hit, event_id % 3 = 0 AS form FROM events)
SELECT event_id, round(CAST(0.9 * CAST(hit AS INTEGER) + 0.1 * CAST(form AS INTEGER) AS DOUBLE), 6) AS overall, CAST(hit AS DOUBLE) AS accuracy, CAST(form AS DOUBLE) AS format FROM e""")
def score_math(spark, folder):
    text = F.expr(r"CASE event_id % 3 WHEN 0 THEN '<think>so</think> it is \\boxed{' || CAST(event_id % 5 AS STRING) || '}' WHEN 1 THEN '\\boxed{9} \\boxed{ ' || CAST(event_id % 5 AS STRING) || '}' ELSE CAST(event_id % 5 AS STRING) END")
    s = R.score("math", text, F.expr("CAST(user_id % 5 AS STRING)"))
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"), s["accuracy"].alias("accuracy"), s["format"].alias("format"))


@query("score_logic", """SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN -1.5 WHEN event_id % 3 = 0 THEN 1.0 ELSE -1.0 END + CASE WHEN event_id % 2 = 1 THEN -0.5 ELSE 0.0 END AS DOUBLE) AS overall, CAST(event_id % 5 > 0 AND event_id % 3 = 0 AS DOUBLE) AS accuracy FROM events""")
def score_logic(spark, folder):
    text = F.expr("'<think>alpha beta ' || CASE WHEN event_id % 2 = 1 THEN 'Gamma' ELSE '' END || '</think> ' || CASE WHEN event_id % 3 = 0 THEN 'ALPHA ' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN 'Beta' ELSE '' END")
    one = lambda w: F.array(F.lit(w))
    s = R.score("logic", text, one("alpha"), one("beta"), one("gamma"))
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"), s["accuracy"].alias("accuracy"))


_DIAGNOSIS = "CASE event_id % 4 WHEN 0 THEN '<answer> Malignant </answer>' WHEN 1 THEN 'Answer : benign' WHEN 2 THEN 'it is benign' ELSE '<answer>benign</answer> but cannot determine' END"
_TRUE_NAME = "CASE WHEN user_id % 2 = 0 THEN 'malignant' ELSE 'benign' END"
_HIT = f"(event_id % 4 = 0 AND {_TRUE_NAME} = 'malignant' OR event_id % 4 IN (1, 3) AND {_TRUE_NAME} = 'benign')"


@query("score_verdict", f"SELECT event_id, CAST(CASE WHEN event_id % 4 >= 2 THEN -1.5 WHEN {_HIT} THEN 1.5 ELSE -1.0 END AS DOUBLE) AS overall, CAST({_HIT} AS DOUBLE) AS acc, CAST(event_id % 4 = 3 AS DOUBLE) AS ambiguous FROM events")
def score_verdict(spark, folder):
    s = R.score("verdict", F.expr(_DIAGNOSIS), F.expr(_TRUE_NAME), ambiguous=["cannot determine"], names=["malignant", "benign"])
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"), s["acc"].alias("acc"), s["ambiguous"].alias("ambiguous"))


@query("score_structure", f"SELECT event_id, round(CAST(CAST({_HIT} AND event_id % 4 < 3 AS INTEGER) + CASE WHEN event_id % 6 = 0 THEN 0.6 WHEN event_id % 2 = 0 THEN 0.5 WHEN event_id % 3 = 0 THEN 0.3 ELSE 0.0 END AS DOUBLE), 6) AS overall FROM events")
def score_structure(spark, folder):
    text = F.concat(F.expr(_DIAGNOSIS), F.expr("CASE WHEN event_id % 2 = 0 THEN ' Margin' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' echo' ELSE '' END"))
    s = R.score("structure", text, F.expr(_TRUE_NAME), ambiguous=["cannot determine"], names=["malignant", "benign"], weights={"margin": 0.5, "echo": 0.3}, most=0.6)
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"))


@query("score_label", f"SELECT event_id, {_REWARD.format(p=f'({_MEANT})', g=f'({_GOLD})')} AS overall, CAST(coalesce(({_MEANT}) = ({_GOLD}), false) AS DOUBLE) AS acc FROM events")
def score_label(spark, folder):
    s = R.score("label", F.concat(F.lit("<answer>"), F.expr(_SAID), F.lit("</answer>")), F.expr(_GOLD), _ALIASES, _names())
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"), s["acc"].alias("acc"))


_LETTER = "CASE WHEN event_id % 3 = 0 THEN chr(CAST(65 + user_id % 2 AS INT)) ELSE 'A' END"
_STEP = "CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END"


@query("score_stepwise", f"SELECT event_id, round(CASE WHEN {_LETTER} = 'A' THEN {R.RIGHT} ELSE {R.WRONG} END + ({_STEP}) / 2.0, 6) AS overall, ({_STEP}) / 2.0 AS bonus FROM events")
def score_stepwise(spark, folder):
    text = F.expr(f"'A: ' || CASE WHEN event_id % 7 < 3 THEN 'One' ELSE 'none' END || chr(10) || 'B. ' || CASE WHEN event_id % 2 = 0 THEN 'two!' ELSE 'three' END || chr(10) || 'Final: ' || {_LETTER}")
    s = R.score("stepwise", text, F.lit("A"), F.array(F.lit("one"), F.lit("Two")))
    return _events(spark, folder).select("event_id", F.round(s["overall"], 6).alias("overall"), s["bonus"].alias("bonus"))


@query("score_mixed", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_REWARD.format(p=f'({_MEANT})', g=f'({_GOLD})')} ELSE CAST({R.UNREADABLE} AS DOUBLE) END AS overall FROM events")
def score_mixed(spark, folder):
    """Rows with candidates are scored as labels; the others say no word of same and different, which is unreadable there."""
    some = F.when(F.col("event_id") % 2 == 0, _names())
    s = R.score("mixed", F.concat(F.lit("<answer>"), F.expr(_SAID), F.lit("</answer>")), F.when(F.col("event_id") % 2 == 0, F.expr(_GOLD)).otherwise("same"), F.array().cast("array<string>"), _ALIASES, some)
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"))


@query("score_final", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 3 = user_id % 3 ELSE true END AS DOUBLE) AS overall FROM events")
def score_final(spark, folder):
    text = F.expr("CASE WHEN event_id % 2 = 0 THEN 'answer: ' || chr(CAST(65 + event_id % 3 AS INT)) ELSE '<answer>B and A</answer>' END")
    s = R.score("final", text, F.expr("CASE WHEN event_id % 2 = 0 THEN chr(CAST(65 + user_id % 3 AS INT)) ELSE 'A B' END"))
    return _events(spark, folder).select("event_id", s["overall"].alias("overall"))


@query("masked_task_whiten", f"""WITH {TOKENS}, w AS (SELECT vec_id, 't' || (uid % 4) AS task, i, arr[i] * CASE uid % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.5 END AS v, mask[i] AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM tokens)),
s AS (SELECT task, avg(v) AS a, stddev_pop(v) AS sd, count(*) AS n FROM w WHERE m = 1 GROUP BY task)
SELECT vec_id, i AS pos, round(CASE WHEN n >= 100 AND m = 1 THEN (v - a) / (sd + 1e-6) ELSE v END, 5) + 0.0 AS advantage FROM w JOIN s ON w.task = s.task""")
def masked_task_whiten(spark, folder):
    df = tokens(spark, folder).select("vec_id", F.concat(F.lit("t"), (F.col("uid") % 4).cast("string")).alias("task"), F.col("arr").alias("advantages"), "mask")
    done = G.task_ops_masked(df, {"t0": 2.0, "t1": 0.5, "*": 1.5}, 100, eps=1e-6)
    return done.select("vec_id", F.posexplode("advantages")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), (F.round("col", 5) + 0.0).alias("advantage"))


@query("estimator_by_name", """WITH r AS (SELECT user_id AS uid, event_id AS sid, value AS score FROM events), g AS (SELECT *, sum(score) OVER (PARTITION BY uid) AS s, count(*) OVER (PARTITION BY uid) AS n FROM r)
SELECT uid, sid, round(score - (s - score) / (n - 1), 6) AS advantage FROM g WHERE n > 1""")
def estimator_by_name(spark, folder):
    from pyspark.sql import Window

    e = _events(spark, folder).select(F.col("user_id").alias("uid"), F.col("event_id").alias("sid"), F.col("value").alias("score")).withColumn("_n", F.count("*").over(Window.partitionBy("uid"))).where("_n > 1").drop("_n")
    return G.estimate("rloo", e).select("uid", "sid", F.round("advantage", 6).alias("advantage"))
