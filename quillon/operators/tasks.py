"""Contrastive multi-item tasks drawn from label spaces, without retries.

Labels of a space and items of a label are ranked by hash. A request draws a space, a target label and shifts by
hash; every slot of its task then names a label rank and an item rank, which joins look up. Eligibility is decided
first, so every request yields a row, and requests of any number run as one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """slots: (which other label, 0 the target's; item shift) of each shown item; fixed ones come first, unshuffled."""

    name: str
    slots: tuple[tuple[int, int], ...]
    fixed: int = 0
    extra: int = 0  # further labels beyond those shown

    @property
    def labels(self) -> int:
        return max(m for m, _ in self.slots) + 1 + self.extra

    @property
    def items(self) -> int:
        return max(s for _, s in self.slots) + 1


def target_search(k: int) -> Task:
    """One item of the target label among k of distinct labels (T-01)."""
    return Task("b1", tuple((j, 0) for j in range(k)))


def odd_one_out(k: int) -> Task:
    """k - 1 items of one label and one of another (T-02)."""
    return Task("b2", (*((0, j) for j in range(k - 1)), (1, 0)))


def label_corruption(k: int) -> Task:
    """k items with their labels, one of which is shown as a label outside the set (T-03)."""
    return Task("b3", tuple((j, 0) for j in range(k)), extra=1)


def exemplar_match(n: int) -> Task:
    """A reference, another item of its label, and n - 1 of others (T-04)."""
    return Task("b4", ((0, 0), (0, 1), *((j, 0) for j in range(1, n))), fixed=1)


def same_different() -> Task:
    """Two items; slot 1 is the same label's, slot 2 another's, and a draw leaves one out (T-05)."""
    return Task("b5", ((0, 0), (0, 1), (1, 0)), fixed=3)


def pair_finding(k: int) -> Task:
    """Two items of one label and k - 2 of distinct others (T-06)."""
    return Task("b6", ((0, 0), (0, 1), *((j, 0) for j in range(1, k - 1))))


def support_set(n: int) -> Task:
    """A query of the target label, then one item of each of n labels (T-07)."""
    return Task("b7", ((0, 1), *((j, 0) for j in range(n))), fixed=1)


def number(*parts: str | Column) -> Column:
    """A 32-bit number from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def ranked_space(items: DataFrame, task: Task, seed: int) -> tuple[DataFrame, DataFrame]:
    """(spaces with rank and labels, items with label and item ranks) of what the task can draw from (C-17, A-16)."""
    s = str(seed)
    sized = items.groupBy("space", "label").agg(F.count("*").alias("n_items")).where(F.col("n_items") >= task.items)
    by_space = Window.partitionBy("space")
    order = F.md5(F.concat_ws("|", F.lit(s), F.lit("label"), "space", "label"))
    labels = sized.withColumn("n_labels", F.count("*").over(by_space)).where(F.col("n_labels") >= task.labels).withColumn("label_rank", F.row_number().over(by_space.orderBy(order, "label")) - 1)
    spaces = labels.groupBy("space").agg(F.first("n_labels").alias("n_labels"))
    everything = Window.partitionBy()  # spaces are few
    spaces = spaces.withColumn("space_rank", F.row_number().over(everything.orderBy("space")) - 1).withColumn("n_spaces", F.count("*").over(everything))
    own = Window.partitionBy("space", "label").orderBy(F.md5(F.concat_ws("|", F.lit(s), F.lit("item"), F.col("image").cast("string"))), "image")
    ranked = items.join(labels, ["space", "label"]).withColumn("item_rank", F.row_number().over(own) - 1)
    return spaces, ranked


def draw(items: DataFrame, task: Task, requests: int, seed: int) -> DataFrame:
    """i, space, slot, image, label, place for each slot of each request; place is the shown order."""
    s = str(seed)
    spaces, ranked = ranked_space(items, task, seed)
    i = F.col("i")
    asked = items.sparkSession.range(requests).select(F.col("id").alias("i"))
    count = spaces.agg(F.max("n_spaces").alias("_spaces"))
    placed = asked.crossJoin(F.broadcast(count)).withColumn("space_rank", number(s, task.name, i, "space") % F.col("_spaces")).join(spaces, "space_rank")  # count is one row
    target = number(s, task.name, i, "label") % F.col("n_labels")
    shift = number(s, task.name, i, "other") % (F.col("n_labels") - 1)
    slots = F.array(*[F.struct(F.lit(j).alias("slot"), F.lit(m).alias("m"), F.lit(n).alias("shift")) for j, (m, n) in enumerate(task.slots)])
    each = placed.withColumn("target", target).withColumn("other", shift).withColumn("s", F.explode(slots))
    rank = F.when(F.col("s.m") == 0, F.col("target")).otherwise((F.col("target") + 1 + (F.col("other") + F.col("s.m") - 1) % (F.col("n_labels") - 1)) % F.col("n_labels"))
    each = each.withColumn("label_rank", rank.cast("int")).withColumn("slot", F.col("s.slot")).withColumn("shift", F.col("s.shift"))
    sizes = ranked.select("space", "label_rank", "n_items").distinct()
    each = each.join(sizes, ["space", "label_rank"]).withColumn("item_rank", ((number(s, task.name, i, "item", F.col("label_rank")) + F.col("shift")) % F.col("n_items")).cast("int"))
    found = each.join(ranked.select("space", "label_rank", "item_rank", "image", "label"), ["space", "label_rank", "item_rank"])
    key = F.when(F.col("slot") < task.fixed, F.concat(F.lit(" "), F.lpad(F.col("slot").cast("string"), 3, "0"))).otherwise(F.md5(F.concat_ws("|", F.lit(s), F.lit(task.name), i.cast("string"), F.lit("order"), F.col("slot").cast("string"))))
    place = F.row_number().over(Window.partitionBy("i").orderBy(key, "slot")) - 1
    return found.withColumn("place", place).select("i", "space", "slot", "image", "label", "place")


def _letter(slots: Column, slot: int, first: int = 0) -> Column:
    return F.chr(65 - first + F.get(F.filter(slots, lambda x: x["slot"] == slot), F.lit(0))["place"])


def build(items: DataFrame, task: Task, requests: int, seed: int, same: float = 0.5) -> DataFrame:
    """i, space, images and labels in shown order, and the answer of each request (T-10)."""
    s = str(seed)
    rows = draw(items, task, requests, seed).groupBy("i", "space").agg(F.sort_array(F.collect_list(F.struct("place", "slot", "image", "label"))).alias("slots"))
    slots = F.col("slots")
    if task.name == "b1":
        answer = _letter(slots, 0)
    elif task.name == "b2":
        answer = _letter(slots, len(task.slots) - 1)
    elif task.name == "b3":
        answer = F.chr(65 + number(s, task.name, F.col("i"), "corrupt") % len(task.slots))
    elif task.name in ("b4", "b7"):
        answer = _letter(slots, 1, 1)
    elif task.name == "b5":
        alike = number(s, task.name, F.col("i"), "same") < int(same * 2**32)
        rows = rows.withColumn("slots", F.filter(slots, lambda x: (x["slot"] == 0) | (x["slot"] == F.when(alike, 1).otherwise(2))))
        answer = F.when(alike, "same").otherwise("different")
    else:
        answer = F.array_join(F.array_sort(F.array(_letter(slots, 0), _letter(slots, 1))), " ")
    return rows.select("i", "space", F.transform("slots", lambda x: x["image"]).alias("images"), F.transform("slots", lambda x: x["label"]).alias("labels"), answer.alias("answer"))


def candidates(label: Column, pool: Column, n: int, seed: int, key: Column) -> Column:
    """n labels of a pool in hashed order, the right one among them (T-08, T-09)."""
    ordered = F.transform(F.array_sort(F.transform(F.array_except(pool, F.array(label)), lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), x)).alias("h"), x.alias("x")))), lambda p: p["x"])
    return F.array_sort(F.concat(F.array(label), F.slice(ordered, 1, n - 1)))


def parse_counts(text: str) -> dict[str, int]:
    """'b1=10,b2:5' as a map (T-14)."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, count = part.replace(":", "=").partition("=")
        out[name.strip()] = int(count)
    return out


def expand(df: DataFrame, column: str, key: str, prefix: str) -> DataFrame:
    """A row per element with an id of prefix, row number and place (T-16, T-17)."""
    return df.select("*", F.posexplode(column).alias("_at", "element")).withColumn("id", F.format_string(f"{prefix}_%06d_%02d", F.col(key).cast("long"), F.col("_at") + 1)).drop("_at")
