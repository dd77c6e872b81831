"""Sampling, splitting, mixing and shuffling, each decided by the rank of an md5 over seed, operator and key.

A hash instead of a generator's state makes a draw the same on any cluster and in any SQL engine, and lets every
task rank its rows alone. Ties are broken by the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import with_positions

DIGITS = 3  # of a draw that name its bucket: 4096 buckets a group


def draw(seed: int, op: str, *keys: str | Column) -> Column:
    """The hash that orders a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(op), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def ranked(df: DataFrame, drawn: Column, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``_rank`` (from 1) of each row by a hashed draw within ``by``, and ``_total``, the rows of its group; no group lands in one task.

    A draw is a hash, so its first digits cut a group into buckets of about equal size. Rows are numbered within a bucket;
    what comes before it is a sum over the counts of buckets, at most 4096 a group. Nulls in ``by`` are a group of their own.
    """
    parts = [*by, "_bucket"]
    keyed = df.withColumn("_draw", drawn).withColumn("_bucket", F.substring("_draw", 1, DIGITS))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy(*parts).agg(F.count("*").alias("_n")).withColumn("_before", before).withColumn("_total", F.sum("_n").over(group))
    counts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(parts)], "_before", "_total")
    own = keyed.withColumn("_own", F.row_number().over(Window.partitionBy(*parts).orderBy("_draw", key)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(parts)])
    return own.join(counts, same).withColumn("_rank", F.col("_before") + F.col("_own")).drop("_draw", "_bucket", "_own", "_before", *[f"_by{i}" for i in range(len(parts))])


def parse_ratios(text: str) -> tuple[float, float, float]:
    """Three ratios, separated by commas, colons or slashes, scaled to sum to 1 (L-02)."""
    parts = [float(x) for x in text.replace(":", ",").replace("/", ",").split(",") if x.strip()]
    if len(parts) != 3 or min(parts) < 0 or sum(parts) <= 0:
        raise ValueError(f"three ratios are needed: {text!r}")
    return tuple(x / sum(parts) for x in parts)


def split_by_group(df: DataFrame, group: str, seed: int, ratios: tuple[float, float, float]) -> DataFrame:
    """split: train, val or test, whole groups at a time (L-01): cut at floor(groups * ratio), the rest is test.

    Groups are far fewer than rows; only they are ranked, then joined back.
    """
    groups = ranked(df.select(group).distinct(), draw(seed, "split", group), group)
    train, val = F.floor(F.col("_total") * ratios[0]), F.floor(F.col("_total") * ratios[1])
    parts = groups.select(F.col(group).alias("_group"), F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test").alias("split"))
    return df.join(parts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def fewshot_by_ratio(df: DataFrame, label: str, key: str, seed: int, ratio: float) -> DataFrame:
    """A balanced share of the rows (L-03): round-half-even(rows * ratio), one at least, in equal quotas.

    The remainder goes to the first labels of a hashed order; a label that has fewer rows isn't filled up from others.
    """
    known = df.where(F.col(label).isNotNull())
    target = df.agg(F.greatest(F.bround(F.count("*") * F.lit(ratio), 0), F.lit(1)).cast("long").alias("_target"))
    labels = ranked(known.select(label).distinct(), draw(seed, "label", label), label).crossJoin(F.broadcast(target))  # one row
    quota = labels.select(F.col(label).alias("_label"), (F.floor(F.col("_target") / F.col("_total")) + F.when(F.col("_rank") <= F.col("_target") % F.col("_total"), 1).otherwise(0)).alias("_quota"))
    own = ranked(known, draw(seed, "fewshot", key), key, [label])
    return own.join(quota, F.col(label) == F.col("_label")).where(F.col("_rank") <= F.col("_quota")).drop("_rank", "_total", "_label", "_quota")


def kshot(df: DataFrame, label: str, key: str, seed: int, k: int, strict: bool = True) -> DataFrame:
    """k rows of each label (L-04); strict: a label with fewer is an error. Tasks keep k rows of a label before they shuffle."""
    by_label = Window.partitionBy(label)
    kept = df.withColumn("_rank", F.row_number().over(by_label.orderBy(draw(seed, "kshot", key), key))).where(F.col("_rank") <= k).drop("_rank")
    if not strict:
        return kept
    counted = kept.withColumn("_n", F.count("*").over(by_label))  # k rows at most
    return counted.where(F.assert_true(F.col("_n") >= k, F.concat(F.lit("too few rows of label "), F.col(label).cast("string"))).isNull()).drop("_n")


def kshot_and_rest(df: DataFrame, label: str, key: str, seed: int, k: int) -> DataFrame:
    """split: k rows of each label are train, the others test (L-05)."""
    return ranked(df, draw(seed, "kshot", key), key, [label]).withColumn("split", F.when(F.col("_rank") <= k, "train").otherwise("test")).drop("_rank", "_total")


def mini(df: DataFrame, label: str, key: str, seed: int, total: int) -> DataFrame:
    """About ``total`` rows: max(1, round(total / labels)) of each label (L-06)."""
    labels = df.select(F.count_distinct(label).alias("_labels"))
    own = ranked(df, draw(seed, "mini", key), key, [label]).crossJoin(F.broadcast(labels))  # one row
    return own.where(F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.lit(total) / F.col("_labels"), 0))).drop("_rank", "_total", "_labels")


def apportion(total: int, weights: Sequence[float]) -> list[int]:
    """Largest-remainder shares of ``total`` (L-07); equal remainders go to later inputs first."""
    if total < 0 or not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("a total and weights that aren't negative are needed")
    exact = [total * w / sum(weights) for w in weights]
    counts = [int(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (exact[i] - counts[i], i), reverse=True)
    for i in order[: total - sum(counts)]:
        counts[i] += 1
    return counts


def sample(df: DataFrame, key: str, seed: int, op: str, n: int) -> DataFrame:
    """n rows without replacement, the first by hash (L-13), in any number of tasks: nothing is limited to one.

    Only the buckets of the hash that the first n rows reach are read on; their counts, 4096 at most, are broadcast.
    """
    keyed = df.withColumn("_draw", draw(seed, op, key)).withColumn("_bucket", F.substring("_draw", 1, DIGITS))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = keyed.groupBy("_bucket").count().withColumn("_before", before).where(F.col("_before") < n).select("_bucket", "_before")
    near = keyed.join(F.broadcast(reached), "_bucket").withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", key)))
    return near.where((F.col("_own") <= n) & (F.col("_before") + F.col("_own") <= n)).select(*df.columns)


def mix(inputs: Sequence[tuple[str, DataFrame]], key: str, weights: Sequence[float], total: int, seed: int) -> DataFrame:
    """``total`` rows from all inputs by weight, without replacement (L-07, U-01); column ``input`` names the source."""
    parts = [sample(df, key, seed, name, n).withColumn("input", F.lit(name)) for (name, df), n in zip(inputs, apportion(total, weights), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_replacement(df: DataFrame, key: str, seed: int, op: str, n: int, rows: int) -> DataFrame:
    """n draws of any of the rows: draw i takes the row at a hashed place by key, nulls last. An empty table gives none."""
    placed = with_positions(df, F.asc_nulls_last(key)).withColumnRenamed("_pos", "_place")
    wanted = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(draw(seed, op, F.col("id")), 1, 8), 16, 10).cast("long"), F.lit(max(1, rows))).alias("_want"))
    return wanted.join(placed, F.col("_want") == F.col("_place")).drop("_want", "_place")


def oversample(df: DataFrame, key: str, seed: int, op: str, n: int, rows: int) -> DataFrame:
    """n rows: without replacement where there are enough, else with (L-08); ``draw`` is null without."""
    if n <= rows:
        return sample(df, key, seed, op, n).withColumn("draw", F.lit(None).cast("long"))
    return with_replacement(df, key, seed, op, n, rows)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in hashed order (L-09, L-10): a range-partitioned sort, which spills by itself."""
    return df.orderBy(draw(seed, "shuffle", key), key)


def folds(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """fold of each row: equal shares by hash."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(draw(seed, "fold", key), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def expand_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row once for each held-out fold, as val where it is its own, else train (L-12, C-14, U-07)."""
    each = df.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.withColumn("role", F.when(F.col("held_out") == F.col(fold), "val").otherwise("train"))


def retained(df: DataFrame, step: str, best: int | None, limit: int) -> DataFrame:
    """Checkpoints to keep (L-14): the newest, one place less where the best is pinned, and the best."""
    rest = df if best is None else df.where(F.col(step) != best)
    newest = rest.orderBy(F.desc(step)).limit(max(0, limit - (best is not None)))
    return newest if best is None else newest.unionByName(df.where(F.col(step) == best))


def mixed_rule(pos: Column, ratio: float) -> Column:
    """Whether a place takes a comparative sample: (i mod 100) < 100 * ratio (L-19)."""
    return F.pmod(pos, F.lit(100)) < 100 * ratio


def dedupe(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key all stay (U-02). A hot key is reduced map-side, not windowed."""
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    kept = df.join(first, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_first")), "left_semi")
    return kept.unionByName(df.where(F.col(key).isNull()))


def top2(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The two best rows of each group (L-16)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))).where("rank <= 2")
