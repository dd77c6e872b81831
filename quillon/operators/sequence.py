"""Per-token algebra over array columns: masked means, scans from the end, divergences and losses.

Arrays of a row have one length. Scans along a row are Arrow UDFs, linear in its length; all else stays in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y)


def masked_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Row-wise mean where the mask is 1; eps stands in the denominator (A-25)."""
    return total(product(values, mask)) / (total(mask) + eps)


def _scan(step, zero):
    """A column function of three arrays: out[t] = value of step(carry, a[t], b[t], c[t]) from the end, in one pass over each row.

    Growing an array inside an aggregate copies it at every step; here a row costs its length. Rows come in Arrow batches.
    """

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for row in zip(a, b, c, strict=True):
            if any(x is None for x in row):
                out.append(None)
                continue
            carry, values = zero, []
            for at in zip(*(np.asarray(x, float).tolist()[::-1] for x in row), strict=True):
                carry, value = step(carry, *at)
                values.append(value)
            out.append(values[::-1])
        return pd.Series(out)

    return run


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns from the end with the carry reset where the mask is 0 (W-04)."""

    def step(carry, r, m, _):
        value = r + gamma * carry
        return value * m, value

    return _scan(step, 0.0)(rewards, mask, mask)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; a masked step keeps the carried value and advantage (W-06), each row for itself."""

    def step(carry, r, v, m):
        after, last = carry
        value = r + gamma * after - v + gamma * lam * last
        new = (v, value) if m == 1 else carry
        return new, new[1]

    return _scan(step, (0.0, 0.0))(rewards, values, mask)


def remax(rewards: Column, mask: Column, baseline: Column) -> tuple[Column, Column]:
    """(advantages, returns) of W-05: the summed reward less the baseline on each valid token; reverse sums of masked rewards."""
    level = total(rewards) - baseline
    returns = _scan(lambda carry, r, m, _: (carry + r * m, carry + r * m), 0.0)(rewards, mask, mask)
    return F.transform(mask, lambda m: m * level), returns


def masked_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row over all valid tokens: n, mean, var. The variance is unbiased where the mask sums to more than 1 (A-25)."""
    n, s = total(F.col(mask)), total(product(F.col(values), F.col(mask)))
    mean = df.agg(F.sum(n).alias("_n"), (F.sum(s) / (F.sum(n) + 1e-8)).alias("_mean"))
    joined = df.select(values, mask).crossJoin(F.broadcast(mean))  # one row
    squares = F.aggregate(F.zip_with(values, mask, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), F.lit(0.0), lambda a, z: a + z["m"] * F.pow(z["x"] - F.col("_mean"), 2))
    summed = joined.agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(squares).alias("_squares"))
    biased = F.col("_squares") / (F.col("n") + 1e-8)
    return summed.select("n", "mean", F.when(F.col("n") > 1, biased * F.col("n") / (F.col("n") - 1)).otherwise(biased).alias("var"))


def whiten(df: DataFrame, values: str, mask: str, out: str, eps: float = 1e-8) -> DataFrame:
    """out: values less the global masked mean, over sqrt(var + eps) (W-13); the statistics are one broadcast row."""
    s = masked_stats(df, values, mask).select(F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    joined = df.crossJoin(F.broadcast(s))
    return joined.withColumn(out, F.transform(F.col(values), lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + eps))).drop("_mean", "_var")


def kl(log_probs: Column, reference: Column, kind: str) -> Column:
    """Per-token divergence (W-09): kl, abs, mse or low_var_kl. The full form needs logits, which are no data here."""
    forms = {
        "kl": lambda p, q: p - q,
        "abs": lambda p, q: F.abs(p - q),
        "mse": lambda p, q: 0.5 * (p - q) * (p - q),
        "low_var_kl": lambda p, q: F.greatest(F.least(F.exp(_clamp(q - p, 20.0)) - _clamp(q - p, 20.0) - 1, F.lit(10.0)), F.lit(-10.0)),
    }
    if kind not in forms:
        raise ValueError(f"unknown divergence {kind}")
    return F.zip_with(log_probs, reference, lambda p, q: forms[kind](p.cast("double"), q.cast("double")))


def _clamp(x: Column, most: float, least: float | None = None) -> Column:
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most if least is None else least))


def kl_penalised(scores: Column, log_probs: Column, reference: Column, mask: Column, coefficient: float, kind: str = "kl") -> Column:
    """Rewards less the weighted divergence on valid tokens (W-08)."""
    return F.zip_with(scores, product(kl(log_probs, reference, kind), mask), lambda s, d: s - coefficient * d)


class KLController:
    """Fixed, or adapted by the clipped error between steps with a horizon (W-10)."""

    def __init__(self, coefficient: float, target: float | None = None, horizon: float = 10_000):
        self.coefficient, self.target, self.horizon = coefficient, target, horizon

    def update(self, current: float, steps: int) -> float:
        if self.target is not None:
            error = max(-0.2, min(0.2, current / self.target - 1))
            self.coefficient *= 1 + error * steps / self.horizon
        return self.coefficient


def policy_terms(log_probs: Column, old: Column, advantages: Column, mask: Column, low: float, high: float, dual: float, kind: str = "default") -> Column:
    """Per-token struct(loss, ratio, up, down, kl) of the clipped policy objective (W-11); kind: default, gspo, gspo_token or cispo."""
    gap = F.zip_with(log_probs, old, lambda p, o: p.cast("double") - o.cast("double"))
    if kind in ("gspo", "gspo_token"):
        # the sequence's mean is bound once, not once a token
        whole = F.transform(F.array(masked_mean(gap, mask)), lambda mean: F.transform(mask, lambda m: mean * m if kind == "gspo" else mean + m * 0))[0]
    log_ratio = whole if kind in ("gspo", "gspo_token") else gap
    left = F.zip_with(log_ratio, advantages, lambda x, a: F.struct(x.alias("l"), a.cast("double").alias("a")))
    right = F.zip_with(gap, log_probs, lambda g, p: F.struct(g.alias("g"), p.cast("double").alias("p")))
    rows = F.zip_with(left, right, lambda x, y: F.struct(x["l"].alias("l"), x["a"].alias("a"), y["g"].alias("g"), y["p"].alias("p")))

    def one(x: Column) -> Column:
        ratio = F.exp(_clamp(x["l"], 20.0))
        clipped = F.exp(_clamp(x["l"], math.log(1 + high), math.log(1 - low)))
        plain, bounded, far = -x["a"] * ratio, -x["a"] * clipped, -x["a"] * dual
        higher = F.greatest(plain, bounded)
        if kind == "cispo":
            loss, up, down = -x["a"] * x["p"] * clipped, F.lit(0.0), F.lit(0.0)
        else:
            loss = F.when(x["a"] < 0, F.least(higher, far)).otherwise(higher)
            up, down = (plain < bounded).cast("double"), ((higher > far) & (x["a"] < 0)).cast("double")
        return F.struct(loss.alias("loss"), ratio.alias("ratio"), up.alias("up"), down.alias("down"), (-x["g"]).alias("kl"))

    return F.transform(rows, one)


def value_terms(predicted: Column, returns: Column, values: Column, clip: float) -> Column:
    """Per-token struct(loss, clipped) of the clipped value objective, before halving (W-12)."""
    rows = F.zip_with(F.zip_with(predicted, returns, lambda p, r: F.struct(p.cast("double").alias("p"), r.cast("double").alias("r"))), values, lambda x, v: F.struct(x["p"].alias("p"), x["r"].alias("r"), v.cast("double").alias("v")))

    def one(x: Column) -> Column:
        bounded = F.greatest(F.least(x["p"], x["v"] + clip), x["v"] - clip)
        a, b = F.pow(x["p"] - x["r"], 2), F.pow(bounded - x["r"], 2)
        return F.struct(F.greatest(a, b).alias("loss"), (a < b).cast("double").alias("clipped"))

    return F.transform(rows, one)


def average_loss(df: DataFrame, values: Column, mask: Column, mode: str, name: str = "loss") -> DataFrame:
    """One row (A-24). token: the masked mean over the batch; seq: the mean of the rows' masked means."""
    if mode == "token":
        return df.agg((F.sum(total(product(values, mask))) / (F.sum(total(mask)) + 1e-8)).alias(name))
    return df.agg(F.avg(masked_mean(values, mask)).alias(name))


def response_mask(ids: Column, stops: list[int]) -> Column:
    """1 up to and with the first stop id, 0 after (W-15)."""
    at = F.array_min(F.filter(F.array(*[F.array_position(ids, F.lit(s)) for s in stops]), lambda p: p > 0))
    return F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: F.when(at.isNull() | (i <= at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running sum of the mask less 1, at least 0 (P-28)."""

    @F.pandas_udf("array<int>")
    def run(masks: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else np.maximum(np.cumsum(m) - 1, 0).tolist() for m in masks])

    return run(mask)


def spread(value: Column, mask: Column) -> Column:
    """A scalar on every valid token (W-19)."""
    return F.transform(mask, lambda m: m * value)


def at_last(value: Column, length: Column, width: int) -> Column:
    """A row of zeros with the value at the last valid place (W-21)."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when(i == length, value).otherwise(F.lit(0.0)))


def fit_length(ids: Column, width: int, pad: int, side: str = "left") -> Column:
    """Pad on the left to ``width``; longer ones lose their start or end, or fail (P-24)."""
    n = F.size(ids)
    padded = F.concat(F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(width) - n, F.lit(0))), ids)
    if side == "left":
        return F.when(n > width, F.slice(ids, n - width + 1, F.lit(width))).otherwise(padded)
    if side == "right":
        return F.when(n > width, F.slice(ids, F.lit(1), F.lit(width))).otherwise(padded)
    return F.when(F.assert_true(n <= width, F.lit("a prompt is too long")).isNull(), padded)


def assemble(prompt: Column, response: Column) -> tuple[Column, Column]:
    """(input ids, position ids) of a prompt followed by its response (P-27)."""
    return F.concat(prompt, response), F.sequence(F.lit(0), F.size(prompt) + F.size(response) - 1)
