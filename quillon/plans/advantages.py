"""Queries over group statistics and per-token algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groupstats as G
from ..operators import sequence as S
from .registry import query
from .views import ROLLOUTS, TOKENS, rollouts, tokens


def _r(c):
    return F.round(c, 6)


@query("adv_grpo", f"WITH {ROLLOUTS} SELECT uid, sid, round((score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6), 6) AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)")
def adv_grpo(spark, folder):
    return G.grpo(rollouts(spark, folder)).select("uid", "sid", _r(F.col("advantage")).alias("advantage"))


@query("adv_passk", f"""WITH {ROLLOUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, sid) AS rk, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM rollouts),
s AS (SELECT uid, score AS second FROM k WHERE rk = 2)
SELECT k.uid, sid, round(CASE WHEN rk = 1 THEN (score - second) / (sd + 1e-6) ELSE score END, 6) AS advantage FROM k JOIN s ON k.uid = s.uid""")
def adv_passk(spark, folder):
    return G.pass_at_k(rollouts(spark, folder)).select("uid", "sid", _r(F.col("advantage")).alias("advantage"))


@query("adv_rloo", f"WITH {ROLLOUTS} SELECT uid, sid, round(score - (sum(score) OVER w - score) / (count(*) OVER w - 1), 6) AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)")
def adv_rloo(spark, folder):
    return G.rloo(rollouts(spark, folder)).select("uid", "sid", _r(F.col("advantage")).alias("advantage"))


@query("group_filter", f"WITH {ROLLOUTS}, m AS (SELECT *, avg(score) OVER (PARTITION BY uid) AS mean FROM rollouts) SELECT uid, sid, score FROM m WHERE mean > 45 AND mean < 55")
def group_filter(spark, folder):
    return G.filter_groups(rollouts(spark, folder), 45, 55).select("uid", "sid", "score")


@query("all_wrong_groups", f"WITH {ROLLOUTS} SELECT uid, count(*) AS n FROM (SELECT *, uid * 100 + sid % 40 AS g FROM rollouts) GROUP BY uid, g HAVING max(correct) < 0.5".replace("SELECT uid, count(*)", "SELECT g AS uid, count(*)").replace("GROUP BY uid, g", "GROUP BY g"))
def all_wrong_groups(spark, folder):
    return G.all_wrong(rollouts(spark, folder).withColumn("uid", F.col("uid") * 100 + F.col("sid") % 40))


@query("selected_groups", f"""WITH {ROLLOUTS}, g AS (SELECT uid * 100 + sid % 40 AS uid, min(sid) AS first, count(*) AS n, avg(correct) AS ratio, max(correct) AS best FROM rollouts GROUP BY 1)
SELECT uid, CAST(row_number() OVER (ORDER BY first, uid) AS INTEGER) AS place, n, round(ratio, 6) AS ratio FROM g WHERE best < 0.5 ORDER BY first, uid LIMIT 20""")
def selected_groups(spark, folder):
    df = rollouts(spark, folder).withColumn("uid", F.col("uid") * 100 + F.col("sid") % 40)
    return G.select_groups(df, 20, only_wrong=True).withColumn("ratio", _r(F.col("ratio")))


@query("correct_ratio", f"""WITH {ROLLOUTS}, r AS (SELECT uid, avg(correct) AS ratio FROM rollouts GROUP BY uid)
SELECT round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS std, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most,
 round(quantile_cont(ratio, 0.25), 6) AS p25, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.75), 6) AS p75, count(*) AS groups FROM r""")
def correct_ratio(spark, folder):
    out = G.correct_ratios(rollouts(spark, folder))
    return out.select(*[_r(F.col(c)).alias(c) if c != "groups" else F.col(c) for c in out.columns])


@query("correct_histogram", f"""WITH {ROLLOUTS}, g AS (SELECT uid * 1000 + sid // 400 AS uid, correct FROM rollouts), r AS (SELECT uid, avg(correct) AS ratio, count(*) AS n FROM g GROUP BY uid)
SELECT CAST(round(ratio * 4) AS BIGINT) AS k, count(*) AS groups FROM r WHERE n = 4 GROUP BY 1""")
def correct_histogram(spark, folder):
    df = rollouts(spark, folder).withColumn("uid", F.col("uid") * 1000 + F.floor(F.col("sid") / 400))
    return G.correct_histogram(df, 4)


@query("task_weight_whiten", f"""WITH {ROLLOUTS}, w AS (SELECT uid, sid, task, score * CASE task WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.5 END AS v FROM rollouts),
s AS (SELECT *, avg(v) OVER t AS m, stddev_pop(v) OVER t AS sd, count(*) OVER t AS n FROM w WINDOW t AS (PARTITION BY task))
SELECT uid, sid, task, round(CASE WHEN n >= 2 THEN (v - m) / (sd + 1e-6) ELSE v END, 6) AS advantage FROM s""")
def task_weight_whiten(spark, folder):
    df = rollouts(spark, folder).withColumn("advantage", F.col("score"))
    return G.task_ops(df, {"click": 2.0, "view": 0.5, "*": 1.5}, 2).select("uid", "sid", "task", _r(F.col("advantage")).alias("advantage"))


@query("weak_classes", f"""WITH {ROLLOUTS}, m AS (SELECT task, avg(score) AS mean FROM rollouts GROUP BY task), r AS (SELECT *, mean <= 10 AS weak, bool_or(mean <= 10) OVER () AS has_weak, row_number() OVER (ORDER BY mean, task) AS rk FROM m)
SELECT task, round(mean, 6) AS mean FROM r WHERE weak OR (NOT has_weak AND rk <= 2)""")
def weak_classes(spark, folder):
    return G.weak_classes(rollouts(spark, folder), 10, 2).select("task", _r(F.col("mean")).alias("mean"))


EACH = "unnest(range(1, 65)) AS i"


@query("adv_remax", f"""WITH {TOKENS}, t AS (SELECT vec_id, i, arr[i] * mask[i] AS r, mask[i] AS m, list_sum(arr) - uid AS level FROM (SELECT *, {EACH} FROM tokens))
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(level * m, 6) + 0.0 AS advantage, round(sum(r) OVER (PARTITION BY vec_id ORDER BY i DESC), 6) AS ret FROM t""")
def adv_remax(spark, folder):
    advantage, returns = S.remax(F.col("arr"), F.col("mask"), F.col("uid").cast("double"))
    df = tokens(spark, folder).select("vec_id", F.posexplode(F.arrays_zip(advantage.alias("a"), returns.alias("r"))))
    return df.select("vec_id", (F.col("pos") + 1).alias("pos"), (_r(F.col("col.a")) + 0.0).alias("advantage"), _r(F.col("col.r")).alias("ret"))


@query("adv_rfpp", f"""WITH {TOKENS}, t AS (SELECT vec_id, i, arr[i] AS r, mask[i] AS m, list_sum(mask) AS n FROM (SELECT *, {EACH} FROM tokens)),
g AS (SELECT a.vec_id, a.i, sum(b.r * pow(0.9, b.i - a.i)) AS ret FROM t a JOIN t b ON a.vec_id = b.vec_id AND b.i >= a.i AND (b.i <= a.n OR b.i = a.i) GROUP BY 1, 2),
f AS (SELECT a.vec_id, a.i, a.m, CASE WHEN a.i = a.n THEN a.r + 0.9 * 0 ELSE g.ret END AS ret FROM t a JOIN g ON a.vec_id = g.vec_id AND a.i = g.i),
s AS (SELECT sum(ret * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM f),
v AS (SELECT any_value(mean) AS mean, sum(m * pow(ret - mean, 2)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM f, s)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round((ret - mean) / sqrt(var + 1e-8), 6) AS advantage FROM f, v WHERE m = 1""")
def adv_rfpp(spark, folder):
    df = tokens(spark, folder).withColumn("ret", S.discounted_returns(F.col("arr"), F.col("mask"), 0.9))
    out = S.whiten(df, "ret", "mask", "adv").select("vec_id", F.posexplode(F.arrays_zip(F.col("adv").alias("a"), F.col("mask").alias("m"))))
    return out.where("col.m = 1").select("vec_id", (F.col("pos") + 1).alias("pos"), _r(F.col("col.a")).alias("advantage"))


@query("adv_gae", f"""WITH RECURSIVE {TOKENS}, t AS (SELECT vec_id, arr, list_transform(range(1, 65), lambda i: arr[65 - i]) AS val, mask FROM tokens),
s AS (SELECT vec_id, 65 AS i, CAST(0 AS DOUBLE) AS nv, CAST(0 AS DOUBLE) AS g FROM t
 UNION ALL SELECT s.vec_id, s.i - 1, CASE WHEN t.mask[s.i - 1] = 1 THEN t.val[s.i - 1] ELSE nv END,
  CASE WHEN t.mask[s.i - 1] = 1 THEN t.arr[s.i - 1] + 0.99 * nv - t.val[s.i - 1] + 0.99 * 0.95 * g ELSE g END FROM s JOIN t ON s.vec_id = t.vec_id WHERE s.i > 1)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(g, 5) AS advantage FROM s WHERE i < 65""")
def adv_gae(spark, folder):
    df = tokens(spark, folder).select("vec_id", F.posexplode(S.gae(F.col("arr"), F.reverse("arr"), F.col("mask"), 0.99, 0.95)))
    return df.select("vec_id", (F.col("pos") + 1).alias("pos"), F.round("col", 5).alias("advantage"))


@query("kl_estimators", f"""WITH {TOKENS}, p AS (SELECT vec_id, {EACH}, arr, mask FROM tokens), t AS (SELECT vec_id, arr[i] AS p, arr[65 - i] AS q, mask[i] AS m FROM p),
k AS (SELECT vec_id, m, p - q AS a, abs(p - q) AS b, 0.5 * (p - q) * (p - q) AS c, greatest(least(exp(greatest(least(q - p, 20.0), -20.0)) - greatest(least(q - p, 20.0), -20.0) - 1, 10.0), -10.0) AS d FROM t)
SELECT vec_id, round(sum(a * m) / (sum(m) + 1e-8), 6) AS kl, round(sum(b * m) / (sum(m) + 1e-8), 6) AS abs, round(sum(c * m) / (sum(m) + 1e-8), 6) AS mse, round(sum(d * m) / (sum(m) + 1e-8), 6) AS low_var_kl FROM k GROUP BY vec_id""")
def kl_estimators(spark, folder):
    df = tokens(spark, folder)
    return df.select("vec_id", *[_r(S.masked_mean(S.kl(F.col("arr"), F.reverse("arr"), k), F.col("mask"))).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")])


@query("kl_penalty", f"""WITH {TOKENS}, t AS (SELECT vec_id, i, arr[i] AS p, arr[65 - i] AS q, mask[i] AS m FROM (SELECT *, {EACH} FROM tokens))
SELECT vec_id, round(sum(p - 0.1 * (p - q) * m), 6) AS reward, round(sum((p - q) * m) / (sum(m) + 1e-8), 6) AS kl FROM t GROUP BY vec_id""")
def kl_penalty(spark, folder):
    p, q, m = F.col("arr"), F.reverse("arr"), F.col("mask")
    return tokens(spark, folder).select("vec_id", _r(S.total(S.kl_penalised(p, p, q, m, 0.1))).alias("reward"), _r(S.masked_mean(S.kl(p, q, "kl"), m)).alias("kl"))


def _policy_sql(kind: str) -> str:
    ratio = {"default": "g", "cispo": "g", "gspo": "sg * m", "gspo_token": "sg"}[kind]
    loss = "-a * p * exp(c)" if kind == "cispo" else "CASE WHEN a < 0 THEN least(greatest(-a * exp(l), -a * exp(c)), -a * 3.0) ELSE greatest(-a * exp(l), -a * exp(c)) END"
    return f"""WITH {TOKENS}, t AS (SELECT vec_id, i, arr[i] AS p, arr[65 - i] AS o, mask[i] AS m, arr[1 + (i * 7) % 64] AS a FROM (SELECT *, {EACH} FROM tokens)),
g AS (SELECT *, p - o AS g, sum((p - o) * m) OVER (PARTITION BY vec_id) / (sum(m) OVER (PARTITION BY vec_id) + 1e-8) AS sg FROM t),
l AS (SELECT *, greatest(least({ratio}, 20.0), -20.0) AS l, greatest(least({ratio}, ln(1.28)), ln(0.8)) AS c FROM g)
SELECT round(sum({loss} * m) / (sum(m) + 1e-8), 6) AS token_loss, round(sum(-g * m) / (sum(m) + 1e-8), 6) AS ppo_kl, round(sum(-p * m) / (sum(m) + 1e-8), 6) AS entropy FROM l"""


def _policy(kind):
    def plan(spark, folder):
        p, o, m = F.col("arr"), F.reverse("arr"), F.col("mask")
        adv = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.element_at("arr", 1 + (i * 7) % 64))
        df = tokens(spark, folder).withColumn("terms", S.policy_terms(p, o, adv, m, 0.2, 0.28, 3.0, kind))
        valid = S.total(m)
        mean = lambda c: _r(F.sum(S.total(S.product(c, m))) / (F.sum(valid) + 1e-8))
        return df.agg(mean(F.transform("terms", lambda x: x["loss"])).alias("token_loss"), mean(F.transform("terms", lambda x: x["kl"])).alias("ppo_kl"), mean(F.transform(p, lambda x: -x)).alias("entropy"))

    return plan


for _kind in ("default", "gspo", "gspo_token", "cispo"):
    query("policy_loss" if _kind == "default" else f"policy_loss_{_kind}", _policy_sql(_kind))(_policy(_kind))


@query("value_loss", f"""WITH {TOKENS}, t AS (SELECT vec_id, arr[i] AS p, arr[65 - i] AS r, arr[1 + (i * 7) % 64] AS v, mask[i] AS m FROM (SELECT *, {EACH} FROM tokens)),
l AS (SELECT vec_id, m, pow(p - r, 2) AS a, pow(greatest(least(p, v + 0.5), v - 0.5) - r, 2) AS b FROM t)
SELECT round(0.5 * sum(greatest(a, b) * m) / (sum(m) + 1e-8), 6) AS loss, round(sum(CASE WHEN a < b THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clipfrac FROM l""")
def value_loss(spark, folder):
    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.element_at("arr", 1 + (i * 7) % 64))
    df = tokens(spark, folder).withColumn("terms", S.value_terms(F.col("arr"), F.reverse("arr"), v, 0.5))
    m = F.col("mask")
    mean = lambda f: F.sum(S.total(S.product(F.transform("terms", lambda x: x[f]), m))) / (F.sum(S.total(m)) + 1e-8)
    return df.agg(_r(0.5 * mean("loss")).alias("loss"), _r(mean("clipped")).alias("clipfrac"))


@query("average_loss", f"""WITH {TOKENS}, t AS (SELECT vec_id, arr[i] * mask[i] AS x, mask[i] AS m FROM (SELECT *, {EACH} FROM tokens)), s AS (SELECT vec_id, sum(x) / (sum(m) + 1e-8) AS mean, sum(x) AS x, sum(m) AS m FROM t GROUP BY vec_id)
SELECT round(sum(x) / (sum(m) + 1e-8), 6) AS token, round(avg(mean), 6) AS seq FROM s""")
def average_loss(spark, folder):
    df = tokens(spark, folder)
    both = S.average_loss(df, F.col("arr"), F.col("mask"), "token", "token").crossJoin(F.broadcast(S.average_loss(df, F.col("arr"), F.col("mask"), "seq", "seq")))  # one row each
    return both.select(_r(F.col("token")).alias("token"), _r(F.col("seq")).alias("seq"))


@query("masked_stats", f"""WITH {TOKENS}, t AS (SELECT arr[i] AS x, mask[i] AS m FROM (SELECT *, {EACH} FROM tokens)), s AS (SELECT sum(x * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM t)
SELECT CAST(any_value(n) AS DOUBLE) AS n, round(any_value(mean), 6) AS mean, round(sum(m * pow(x - mean, 2)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1), 6) AS var FROM t, s""")
def masked_stats(spark, folder):
    out = S.masked_stats(tokens(spark, folder), "arr", "mask")
    return out.select(F.col("n").cast("double").alias("n"), _r(F.col("mean")).alias("mean"), _r(F.col("var")).alias("var"))


@query("response_mask", f"""WITH {TOKENS}, t AS (SELECT vec_id, i, CAST(floor(arr[i] * 8) AS BIGINT) AS id FROM (SELECT *, {EACH} FROM tokens)), e AS (SELECT vec_id, min(i) AS stop FROM t WHERE id IN (3, -4) GROUP BY vec_id)
SELECT t.vec_id, CAST(sum(CASE WHEN stop IS NULL OR i <= stop THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM t LEFT JOIN e ON t.vec_id = e.vec_id GROUP BY t.vec_id""")
def response_mask(spark, folder):
    df = tokens(spark, folder).withColumn("ids", F.transform("arr", lambda x: F.floor(x * 8)))
    mask = S.response_mask(F.col("ids"), [3, -4])
    return df.select("vec_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("valid"))


@query("position_ids", f"""WITH {TOKENS}, t AS (SELECT vec_id, i, mask[65 - i] AS m FROM (SELECT *, {EACH} FROM tokens))
SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(greatest(sum(m) OVER (PARTITION BY vec_id ORDER BY i) - 1, 0) AS BIGINT) AS position FROM t""")
def position_ids(spark, folder):
    df = tokens(spark, folder).withColumn("m", F.reverse("mask"))
    return df.select("vec_id", F.posexplode(S.position_ids(F.col("m")))).select("vec_id", (F.col("pos") + 1).alias("pos"), F.col("col").cast("long").alias("position"))


@query("fit_length", """WITH t AS (SELECT conv_id, turn, list_transform(range(1, length(text) % 40 + 1), lambda x: CAST(x AS BIGINT)) AS ids FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN len(ids) > 16 THEN ids[len(ids) - 15 : len(ids)] ELSE list_concat(list_transform(range(0, 16 - len(ids)), lambda x: CAST(0 AS BIGINT)), ids) END, ' ') AS left_cut,
 array_to_string(CASE WHEN len(ids) > 16 THEN ids[1:16] ELSE list_concat(list_transform(range(0, 16 - len(ids)), lambda x: CAST(0 AS BIGINT)), ids) END, ' ') AS right_cut FROM t""")
def fit_length(spark, folder):
    from .views import table

    n = F.length("text") % 40
    ids = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    df = table(spark, folder, "conversations").withColumn("ids", ids)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return df.select("conv_id", "turn", text(S.fit_length(F.col("ids"), 16, 0)).alias("left_cut"), text(S.fit_length(F.col("ids"), 16, 0, "right")).alias("right_cut"))
