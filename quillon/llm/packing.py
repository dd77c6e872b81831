"""Best-fit packing of token sequences (operator 1).

Only lengths decide a packing, and there are at most ``capacity`` different ones. The plan therefore works on
the histogram of lengths: documents above one third of the capacity are matched greedily, at most two in a
bin; the smaller ones then best-fit the remaining gaps, whole runs of equal lengths at a time. What results
is a table of bin patterns with multiplicities, whose size depends on the capacity, not on the corpus. The
r-th piece of a length takes the r-th place that the patterns hold for that length.

Ranks come from counts by (length, bucket), so a length that a third of all pieces share is numbered in many
tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytelevel import chunks, library_encoder, text_buffer
from .shared import materialise, ship, worker_state

CAPACITY = 2048
END_ID = 0


def encoder(path: str):
    """The worker's encoder for a vocabulary file; its word cache lives until the worker turns to another operator."""
    return worker_state(f"library {path}", lambda: library_encoder(path, added_tokens=True))


@dataclass
class Group:
    """``count`` bins with the same content: runs of (length, how many)."""

    count: int
    gap: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Bin patterns for ``histogram`` (length -> pieces). Every length is from 1 to capacity."""
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    left = {x: n for x, n in histogram.items() if n > 0}
    groups: list[Group] = []
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for x in large:
        while left.get(x, 0) > 0:
            mate = next((y for y in large if y <= x and x + y <= capacity and left.get(y, 0) > (y == x)), None)
            if mate is None:
                groups.append(Group(left[x], capacity - x, [(x, 1)]))
                left[x] = 0
            elif mate == x:
                n = left[x] // 2
                groups.append(Group(n, capacity - 2 * x, [(x, 2)]))
                left[x] -= 2 * n
            else:
                n = min(left[x], left[mate])
                groups.append(Group(n, capacity - x - mate, [(x, 1), (mate, 1)]))
                left[x] -= n
                left[mate] -= n
    by_gap: dict[int, list[Group]] = {}
    for g in groups:
        by_gap.setdefault(g.gap, []).append(g)
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[s]
        for gap in sorted(g for g in by_gap if g >= s):
            each = gap // s
            while n and by_gap[gap]:
                g = by_gap[gap].pop()
                full = min(g.count, n // each)
                for count, take in ((full, each), (min(1, g.count - full) if n - full * each else 0, n - full * each)):
                    if count and take:
                        take = min(take, each)
                        by_gap.setdefault(gap - take * s, []).append(Group(count, gap - take * s, [*g.runs, (s, take)]))
                        n -= count * take
                        g.count -= count
                if g.count:
                    by_gap[gap].append(g)
                if not full and n == 0:
                    break
            if not n:
                break
        each = capacity // s
        if n // each:
            by_gap.setdefault(capacity - each * s, []).append(Group(n // each, capacity - each * s, [(s, each)]))
        if n % each:
            by_gap.setdefault(capacity - (n % each) * s, []).append(Group(1, capacity - (n % each) * s, [(s, n % each)]))
    return [g for gap in sorted(by_gap) for g in by_gap[gap] if g.count]


def places(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, per bin, offset in the bin) of every run of every group."""
    out, rank, sequence = [], {}, 0
    for g in groups:
        offset = 0
        for length, many in g.runs:
            begin = rank.get(length, 0)
            out.append((length, begin, begin + g.count * many, sequence, many, offset))
            rank[length] = begin + g.count * many
            offset += length * many
        sequence += g.count
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, append ``end_id``, cut what is longer than ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32 and, on request, the ids. A null text counts as empty and
    gives one piece that holds the end id. The first piece of a cut document is the shorter one.
    """
    ship(docs.sparkSession)
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in chunks(offsets):
                got = codec.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                rows, piece, start, length, crc, lists = [], [], [], [], [], []
                for i in range(high - low):
                    ids = np.append(got.ids[got.offsets[i] : got.offsets[i + 1]], np.uint32(end_id))
                    at, number = 0, 0
                    while at < len(ids):
                        to = at + (len(ids) % capacity or capacity) if at == 0 else at + capacity
                        part = ids[at:to]
                        rows.append(low + i)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            lists.append(part)
                        at, number = to, number + 1
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField(id_col, key), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def ranked(items: DataFrame, length_col: str, buckets: int) -> DataFrame:
    """Add ``_rank``: 0, 1, 2 ... within each length, any order, without a task that sees all rows of a length.

    items must be materialised: its rows are read twice, once counted and once numbered within their bucket.
    """
    scalar = [F.col(f"`{f.name}`") for f in items.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    bucketed = items.withColumn("_bucket", F.pmod(F.xxhash64(*scalar), F.lit(buckets)))
    counts = bucketed.groupBy(length_col, "_bucket").count()
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(F.col(length_col).alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(length_col, "_bucket").orderBy(*scalar)
    numbered = bucketed.withColumn("_in", F.row_number().over(within) - 1)
    joined = numbered.join(begin, (numbered[length_col] == begin["_l"]) & (numbered["_bucket"] == begin["_b"]))
    return joined.withColumn("_rank", F.col("_in") + F.col("_begin")).drop("_l", "_b", "_begin", "_in", "_bucket")


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length", buckets: int | None = None) -> DataFrame:
    """Add sequence_id and offset to every row of ``items`` (materialised) by its length; an empty table stays empty.

    Only the histogram, at most ``capacity`` rows, reaches the driver. The table of places that goes back is
    bounded by the capacity as well: a pattern holds distinct lengths that sum to at most ``capacity``.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    table = spark.createDataFrame(places(plan(histogram, capacity)), "_length long, _from long, _to long, _sequence long, _many long, _offset long")
    rows = ranked(items, length_col, buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.join(F.broadcast(table), (rows[length_col] == table["_length"]) & (rows["_rank"] >= table["_from"]) & (rows["_rank"] < table["_to"]))
    j = F.col("_rank") - F.col("_from")
    return found.select(*[F.col(f"`{c}`") for c in items.columns], (F.col("_sequence") + F.floor(j / F.col("_many"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(j, F.col("_many")) * F.col(f"`{length_col}`")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack ``docs``; one row per piece.

    Null texts are empty, repeated rows are packed each for itself, ties in length keep any order, further
    columns of docs are not read, and no documents give no rows.
    """
    return pack(materialise(pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)
