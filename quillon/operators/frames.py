"""Batch algebra over ordered frames. Order is an explicit ``_pos`` column, 0, 1, 2 ..., never a partition's layout.

A position that an operator needs anew is numbered in two steps, counts by range partition and then rows within
them, so that no task sees all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"


@dataclass
class Frame:
    """Columns with order, and values that belong to the frame as a whole."""

    df: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    def __len__(self) -> int:
        return self.df.count()

    def select(self, names: list[str], meta: list[str] | None = None) -> Frame:
        """Chosen columns; names that aren't there are ignored (P-01)."""
        kept = [c for c in self.df.columns if c in names or c == POS]
        return Frame(self.df.select(*kept), {k: v for k, v in self.meta.items() if meta is None or k in meta})

    def pop(self, names: list[str]) -> tuple[Frame, Frame]:
        """(chosen columns, the rest) (P-02); an absent name is an error."""
        missing = set(names) - set(self.df.columns)
        if missing:
            raise KeyError(f"no such columns: {sorted(missing)}")
        return Frame(self.df.select(POS, *names), self.meta), Frame(self.df.drop(*names), self.meta)

    def rename(self, old: list[str], new: list[str]) -> Frame:
        """P-03."""
        if len(old) != len(new):
            raise ValueError("as many new names as old ones are needed")
        return Frame(self.df.withColumnsRenamed(dict(zip(old, new, strict=True))), self.meta)

    def item(self, place: int) -> DataFrame:
        """One row (B-09)."""
        return self.df.where(F.col(POS) == place)


def with_positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ``_pos`` by the given order, which must be total. Ranges of the order are counted, then numbered.

    The ranges are kept on disk, since the counts and the numbering must see the same ones; a lost part is made
    again by the same shuffle and partitioner.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    counts = ranged.groupBy("_part").count()
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_own", own).join(F.broadcast(before), F.col("_part") == F.col("_p"))  # a row a partition
    return numbered.withColumn(POS, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_part", "_own", "_p", "_before")


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both by position; a name of both must hold equal values (B-01, J-07)."""
    both = [c for c in right.columns if c in left.columns and c != POS]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in both}).withColumnRenamed(POS, "_right_pos")
    joined = left.join(renamed, F.col(POS) == F.col("_right_pos"), "full")
    fits = F.col(POS).isNotNull() & F.col("_right_pos").isNotNull()
    for c in both:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return joined.where(F.assert_true(fits, F.lit("the frames differ in size or in a shared column")).isNull()).drop("_right_pos", *[f"_right_{c}" for c in both])


def concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames in order (B-02); positions shift by the sizes before."""
    out, offset = None, 0
    for k, df in enumerate(frames):
        moved = df.withColumn(POS, F.col(POS) + F.lit(offset))
        out = moved if out is None else out.unionByName(moved)
        offset += df.count() if k < len(frames) - 1 else 0
    return out


def chunk(df: DataFrame, n: int, size: int) -> DataFrame:
    """chunk id of n equal chunks (B-03); the number of rows, ``size``, must divide."""
    if size % n:
        raise ValueError(f"{size} rows can't be cut into {n} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(POS) * n / size).cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    """part id of pieces of ``size`` rows, the last one shorter (B-04)."""
    return df.withColumn("part", F.floor(F.col(POS) / size).cast("int"))


def repeat(df: DataFrame, times: int, interleave: bool, size: int) -> DataFrame:
    """Every row ``times`` times, next to each other or frame after frame (B-05)."""
    each = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(POS) * times + F.col("_copy") if interleave else F.col("_copy") * F.lit(size) + F.col(POS)
    return each.withColumn(POS, place.cast("long")).drop("_copy")


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    """Row old_pos goes to new_pos (B-06)."""
    return df.join(permutation, F.col(POS) == F.col("old_pos")).withColumn(POS, F.col("new_pos")).drop("old_pos", "new_pos")


def inverse(permutation: DataFrame) -> DataFrame:
    """The permutation that undoes another (B-13)."""
    return permutation.select(F.col("old_pos").alias("new_pos"), F.col("new_pos").alias("old_pos"))


def pad(df: DataFrame, divisor: int, size: int) -> DataFrame:
    """Rows repeated from the start until the divisor divides the size (B-07)."""
    missing = -size % divisor
    if not missing or not size:
        return df
    laps = -(-missing // size)
    more = df.withColumn("_lap", F.explode(F.sequence(F.lit(1), F.lit(laps)))).withColumn(POS, (F.col("_lap") * F.lit(size) + F.col(POS)).cast("long")).drop("_lap")
    return df.unionByName(more.where(F.col(POS) < size + missing))


def unpad(df: DataFrame, size: int) -> DataFrame:
    return df.where(F.col(POS) < size)


def batches(df: DataFrame, size: int, epochs: int, seed: int | None, rows: int) -> DataFrame:
    """epoch, batch and place in the batch (B-08, L-17); shuffled by a hash where a seed is given, last short batches dropped."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        placed = each.withColumn("_at", F.col(POS))
    else:
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(POS).cast("string")))
        from .sampling import ranked  # which needs positions

        placed = ranked(each, key, POS, ["epoch"]).withColumn("_at", F.col("_rank") - 1).drop("_rank", "_total")
    return placed.withColumn("batch", F.floor(F.col("_at") / size).cast("int")).withColumn("place", (F.col("_at") % size).cast("int")).where(F.col("batch") < rows // size).drop("_at")


def take(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows at the listed places, in that order, a place as often as it is listed (C-07)."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "_new long, _old long")
    return df.join(wanted, F.col(POS) == F.col("_old")).withColumn(POS, F.col("_new")).drop("_new", "_old")


def cut(df: DataFrame, start: int | None, stop: int | None, step: int, size: int) -> DataFrame:
    """A slice with Python's rules for negative ends and steps (C-08)."""
    chosen = range(*slice(start, stop, step).indices(size))
    if not chosen:
        return df.where(F.lit(False))
    low, high = min(chosen), max(chosen)
    rows = df.where(F.col(POS).between(low, high) & (F.pmod(F.col(POS) - F.lit(chosen[0]), F.lit(abs(step))) == 0))
    return rows.withColumn(POS, ((F.col(POS) - F.lit(chosen[0])) / F.lit(step)).cast("long"))


def fold(df: DataFrame, n: int, size: int, column: str) -> DataFrame:
    """n rows that hold size / n values each, in order (P-26)."""
    held = chunk(df, n, size).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(POS, column))).alias("_rows"))
    return held.select(F.col("chunk").cast("long").alias(POS), F.transform("_rows", lambda r: r[column]).alias(column))


def check(df: DataFrame, lengths: list[str]) -> DataFrame:
    """Rows whose array columns differ in length or are null (B-11): none in a consistent frame."""
    sizes = [F.size(c) for c in lengths]
    bad = F.lit(False)
    for c, s in zip(lengths, sizes, strict=True):
        bad = bad | F.col(c).isNull() | (s != sizes[0])
    return df.where(bad)


def flatten(values: dict[str, Any], sep: str = "/") -> dict[str, Any]:
    """Nested to flat names (B-17)."""
    out: dict[str, Any] = {}
    for k, v in values.items():
        if isinstance(v, dict):
            out.update({f"{k}{sep}{x}": y for x, y in flatten(v, sep).items()})
        else:
            out[k] = v
    return out


def unflatten(values: dict[str, Any], sep: str = "/") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, v in values.items():
        *path, last = name.split(sep)
        at = out
        for k in path:
            at = at.setdefault(k, {})
        at[last] = v
    return out


def append_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values of a key as one list, in order of the values (B-18)."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))
