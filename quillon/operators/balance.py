"""Length-balanced partitioning and dynamic batches.

Differencing (Karmarkar and Karp) is sequential, so it runs per batch of a bounded number of rows in
``applyInPandas``; batches are independent, and any number of them run side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k index lists with nearly equal sums of lengths, ordered by their least index; ``equal_size`` also makes the sizes equal.

    A state holds k piles, heaviest first. The two states with the widest spread are merged heaviest on lightest,
    until one is left. Equal spreads go by the least index.
    """
    if k < 1 or k > len(lengths) or (equal_size and len(lengths) % k):
        raise ValueError(f"{len(lengths)} items can't be put into {k} piles")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        states = [[(lengths[i], [i]) for i in order[at : at + k]] for at in range(0, len(order), k)]
    else:
        states = [[(lengths[i], [i])] + [(0, [])] * (k - 1) for i in order]
    heap: list[tuple] = []

    def push(piles: Iterable[tuple[int, list[int]]]) -> None:
        piles = sorted(piles, key=lambda p: (-p[0], p[1][:1] or [len(lengths)]))
        heapq.heappush(heap, (piles[-1][0] - piles[0][0], min(i for _, own in piles for i in own), len(heap), piles))

    for s in states:
        push(s)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        push((x[0] + y[0], sorted(x[1] + y[1])) for x, y in zip(a, reversed(b), strict=True))
    piles = [own for _, own in heap[0][3]]
    if any(not p for p in piles):  # zero lengths may leave a pile empty
        for p in piles:
            while not p:
                p.append(max(piles, key=len).pop())
    return sorted((sorted(p) for p in piles), key=lambda p: p[0])


def greedy(lengths: list[int], k: int) -> list[list[int]]:
    """Longest first onto the lightest pile (Q-K2)."""
    heap = [(0, j) for j in range(k)]
    piles: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, j = heapq.heappop(heap)
        piles[j].append(i)
        heapq.heappush(heap, (total + lengths[i], j))
    return [sorted(p) for p in piles]


def partition(df: DataFrame, batch: str, order: str, length: str, k: int, equal_size: bool = False) -> DataFrame:
    """part of every row, by differencing within its batch (Q-K1, Q-K6). A batch is what one training step takes, so it is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        part = pd.Series(0, index=pdf.index)
        for j, own in enumerate(differencing(pdf[length].tolist(), min(k, len(pdf)), equal_size and len(pdf) % k == 0)):
            part[own] = j
        return pdf.assign(part=part)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, order, length).schema.fields)
    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, f"{fields}, part int")


def micro_batches(df: DataFrame, batch: str, order: str, length: str, most: int) -> DataFrame:
    """part of every row (Q-K5): as many parts as ceil(total / most), at most the rows; heaviest by squared lengths first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        lengths = pdf[length].tolist()
        piles = differencing(lengths, max(1, min(len(pdf), -(-sum(lengths) // most))))
        piles.sort(key=lambda p: (-sum(lengths[i] ** 2 for i in p), -p[0]))
        part = pd.Series(0, index=pdf.index)
        for j, own in enumerate(piles):
            part[own] = j
        return pdf.assign(part=part)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, order, length).schema.fields)
    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, f"{fields}, part int")


def imbalance(df: DataFrame, batch: str, part: str, length: str) -> DataFrame:
    """Per batch: least, most and mean sum of lengths over its parts (Q-K4)."""
    sums = df.groupBy(batch, part).agg(F.sum(length).alias("_sum"))
    return sums.groupBy(batch).agg(F.min("_sum").alias("least"), F.max("_sum").alias("most"), F.avg("_sum").alias("mean"))


def imbalance_in_order(df: DataFrame, batch: str, order: str, length: str, k: int) -> DataFrame:
    """The same for runs of floor(rows / k) rows in order; what is left makes a run more (Q-K4, Q-09)."""
    w = Window.partitionBy(batch)
    placed = df.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    return imbalance(placed.withColumn("_run", F.floor(F.col("_at") / F.greatest(F.lit(1), F.floor(F.col("_n") / k)))), batch, "_run", length)


def check_parts(df: DataFrame, batch: str, part: str, k: int) -> DataFrame:
    """Batches whose parts aren't exactly 0 to k - 1 (Q-K3): none when all is well."""
    return df.groupBy(batch).agg(F.array_sort(F.collect_set(part)).alias("_parts")).where(F.col("_parts") != F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x.cast("int")))
