"""Near-duplicate classes by ProbMinHash, banding and verification (operator 5).

Shingles are five words; a shingle seen c times in a text weighs 1 + ln c. Each shingle is a Poisson process whose
rate is its weight and whose arrivals hit random registers; a register keeps the shingle that arrived first. Two
texts agree in a register with their probability Jaccard similarity. A text stops drawing arrivals once they
come later than all its registers hold. Registers are banded, texts that share a band are candidates, and a
link is kept only if the exact Jaccard similarity of the two sets of shingles is at least 0.8.

A passage that one text repeats lowers the probability Jaccard similarity and not that of the sets. A text with
repeated shingles is therefore sketched a second time with all weights 1, where registers agree with the similarity
that is verified. It is banded by both sketches; agreement is counted on the second. For other texts both are the same.

Equal texts are one node from the start. Within a bucket of thousands, comparing all pairs is not needed to know
the classes, so links are sought in three passes, each between classes that are still apart:

1. each node against the least node of its buckets (a count of candidates linear in the nodes);
2. in each bucket that still holds several classes, a maximum spanning forest by the registers' agreement;
3. in what is left, every pair whose registers agree far enough, each compared exactly where its bucket is held,
   and only those that join two classes come out.

Buckets of the last two passes are dealt to tasks in bounded blocks by (bucket, x, y), never by bucket alone; buckets of
the same nodes are looked at once. A bucket of m nodes in c classes that are still apart costs (m / BLOCK)^2 blocks. Classes
are the connected components of the links, by label propagation with pointer jumping; no link or component reaches the driver.

Joins on a key that many rows may share (a bucket, a content, the lead of a class) have an exchange right under each side,
which is what lets adaptive execution split the key's partition; what is aggregated by such a key is written first for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bytelevel import chunks, text_buffer
from .shared import materialise, ship, worker_state

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 8, 30
REGISTERS = ROWS * BANDS
#: Least agreement of registers for a pair to be verified: eight standard errors below SIMILARITY, which a link of exactly
#: that similarity misses with a probability under 1e-12, where banding misses it with 0.004.
LEAST_AGREEMENT = SIMILARITY - 8 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
BLOCK = 1024  # nodes of a bucket that one task compares with as many others
#: Texts that are sketched at once: at most so many, of so many bytes together, or one longer text.
CHUNK_TEXTS, CHUNK_BYTES = 1024, 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = bytes(1 if c == 32 or 9 <= c <= 13 else 0 for c in range(256))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run without white space) and where each text's words begin (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = np.frombuffer(data.tobytes().translate(_SPACE), np.uint8)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n)), pa.py_buffer(data)]).dictionary_encode()
    values = coded.dictionary.to_pylist()
    table = np.fromiter(map(xxh3_64_intdigest, values), np.uint64, len(values))
    word = kind[starts] == 0
    return table[coded.indices.to_numpy()[word]], np.searchsorted(starts[word], offsets, side="left")


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash, count), ordered by text. Fewer than five words are one shingle."""
    n = np.diff(at)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[:-1], many)
    short = np.repeat(n, many) < SHINGLE
    mixed = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = place + k < np.repeat(at[1:], many) if short.any() else None
        w = words[np.minimum(place + k, max(len(words) - 1, 0))]
        w = w if inside is None else np.where(inside, w, np.uint64(k + 1))
        mixed = _mix(mixed * _ODD + w)
    order = np.lexsort((mixed, doc))
    doc, mixed = doc[order], mixed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], mixed[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """ProbMinHash registers (texts x REGISTERS): the shingle that arrives first in each; 0 for a text without shingles. Counts of 1 give those of the sets."""
    rate = 1 + np.log(count)
    total = np.bincount(doc, rate, texts)
    has = total > 0
    held = np.zeros(texts * REGISTERS, np.uint64)
    # nearly all texts are done by this time; the others go on below without a bound
    bound = np.full(texts, np.inf)
    bound[has] = REGISTERS / total[has] * (np.log(REGISTERS) + 6)
    todo = has.copy()
    while todo.any():
        live = np.flatnonzero(todo[doc])
        best = np.full(texts * REGISTERS, np.inf)
        own, h, r, time, number = doc[live], shingle[live], rate[live], np.zeros(len(live)), 0
        limit = bound.copy()
        while len(own):
            number += 1
            draw = _mix(h + np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / r
            keep = time < limit[own]
            own, h, r, time, draw = own[keep], h[keep], r[keep], time[keep], draw[keep]
            register = own * REGISTERS + ((_mix(draw ^ _ODD) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, register, time)
            first = time == best[register]  # only the arrivals of this step that came before all others stay
            held[register[first]] = h[first]
            if number <= 4 or number % 8 == 0:
                limit = np.minimum(limit, best.reshape(texts, REGISTERS).max(axis=1))
        todo &= np.isinf(best.reshape(texts, REGISTERS)).any(axis=1)
        bound[todo] = np.inf
    return held.reshape(texts, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """texts x BANDS; the band's number is part of its key."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * _ODD + parts[:, :, k])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), content (16-byte digest of the words), bands and registers (low 32 bits, of the set) of every text that isn't null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near duplicates", dict)
        for batch in batches:
            sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.binary_length(batch.column(1)).to_numpy())])
            for low, high in chunks(sizes, CHUNK_BYTES, CHUNK_TEXTS):
                data, offsets = text_buffer(pc.utf8_lower(batch.column(1).slice(low, high - low)))
                words, at = word_hashes(data, offsets)
                doc, shingle, count = shingles(words, at)
                held = signatures(doc, shingle, np.ones(len(count)), high - low)
                content = [hashlib.blake2b(words[at[i] : at[i + 1]], digest_size=16).digest() for i in range(high - low)]
                found = list(band_keys(held))
                repeats = np.bincount(doc, count > 1, high - low) > 0
                if repeats.any():
                    own = repeats[doc]
                    weighted = signatures((np.cumsum(repeats) - 1)[doc[own]], shingle[own], count[own], int(repeats.sum()))
                    for i, keys in zip(np.flatnonzero(repeats).tolist(), band_keys(weighted), strict=True):
                        found[i] = np.union1d(found[i], keys)
                empty = np.diff(at) == 0
                bands = pa.array([None if empty[i] else found[i] for i in range(high - low)], pa.list_(pa.int64()))
                registers = pa.array([r.tobytes() for r in held.astype(np.uint32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(content, pa.binary()), bands, registers], ["doc_id", "version", "content", "bands", "registers"])

    return _versions(docs).mapInArrow(run, "doc_id long, version long, content binary, bands array<long>, registers binary")


def _versions(docs: DataFrame) -> DataFrame:
    """doc_id, text and version (a hash of the text) of rows that have both."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near duplicates", dict)
        for batch in batches:
            data, offsets = text_buffer(pa.concat_arrays([pc.utf8_lower(batch.column(2)), pc.utf8_lower(batch.column(3))]))
            n, keep = batch.num_rows, np.zeros(batch.num_rows, bool)
            step = max(1, int(n * CHUNK_BYTES / max(1, len(data))))
            for begin in range(0, n, step):
                end = min(n, begin + step)
                sides = []
                for base in (begin, n + begin):
                    cut = offsets[base : base + end - begin + 1]
                    sides.append(shingles(*word_hashes(data[cut[0] : cut[-1]], cut - cut[0]))[:2])
                (doc_a, a), (doc_b, b) = sides
                size_a, size_b = np.bincount(doc_a, minlength=end - begin), np.bincount(doc_b, minlength=end - begin)
                doc, all_ = np.concatenate([doc_a, doc_b]), np.concatenate([a, b])
                order = np.lexsort((all_, doc))
                doc, all_ = doc[order], all_[order]
                twice = (doc[1:] == doc[:-1]) & (all_[1:] == all_[:-1])
                both = np.bincount(doc[1:][twice], minlength=end - begin)
                keep[begin:end] = both >= SIMILARITY * (size_a + size_b - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    # a lead may have a third of all nodes as its partners: its side comes last, where adaptive execution splits the lead's partition
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of ``edges`` (a, b), a table that is read repeatedly."""
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("step"), F.col("label").alias("old"))
        step = materialise(step, "labels")
        jump = step.select(F.col("node").alias("step"), F.col("step").alias("jump"))
        new = materialise(step.join(jump, "step", "left").select("node", F.least("step", F.coalesce("jump", "step")).alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _pairs(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Row pairs of a block whose classes differ and whose registers agree far enough, those that agree most first."""
    part, node, label = (table[c].to_numpy() for c in ("side", "node", "label"))
    registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint32).reshape(-1, REGISTERS)
    one = np.flatnonzero(part != 2)
    two = np.flatnonzero(part == 2) if (part == 2).any() else one
    firsts, seconds, agreements = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for i in one.tolist():
        other = two[(label[two] != label[i]) & ((node[two] > node[i]) if two is one else True)]
        if len(other):
            agree = (registers[other] == registers[i]).mean(axis=1, dtype=np.float32)
            near = agree >= LEAST_AGREEMENT
            firsts.append(np.full(near.sum(), i, np.int32))
            seconds.append(other[near].astype(np.int32))
            agreements.append(agree[near])
    i, j, agree = (np.concatenate(x) for x in (firsts, seconds, agreements))
    order = np.lexsort((node[j], node[i], -agree))
    for begin in range(0, len(order), 1 << 16):
        yield from zip(i[order[begin : begin + (1 << 16)]].tolist(), j[order[begin : begin + (1 << 16)]].tolist(), strict=True)


def _spanning(table: pa.Table, accepts) -> pa.Table:
    """Pairs (a, b) that join classes of a block that are still apart, among those that ``accepts`` takes: less than one a class."""
    node, label = table["node"].to_numpy(), table["label"].to_pylist()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j in _pairs(table):
        x, y = find(label[i]), find(label[j])
        if x != y and accepts(i, j):
            root[x] = y
            kept.append((i, j))
    a, b = (node[[pair[k] for pair in kept]] if kept else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _likely(table: pa.Table) -> pa.Table:
    return _spanning(table, lambda i, j: True)


def _exact(table: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]

    def similar(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        if len(a) < SIMILARITY * len(b):
            return False
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9

    return _spanning(table, similar)


def _blocks(active: DataFrame, payload: DataFrame, compare) -> DataFrame:
    """What ``compare`` finds in each bucket of ``active`` (bucket, node, label; materialised), each node with its ``payload``.

    A bucket of more than BLOCK nodes is compared in pairs (x, y) of parts. Rows are dealt by (bucket, x, y) explicitly:
    the partitioning that the joins leave, by bucket or node, would satisfy the grouping and put a whole bucket into one task.
    """
    hot = active.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = active.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    keyed = dealt.select("bucket", "node", "label", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).alias("side"))
    full = keyed.join(payload, "node").repartition("bucket", "x", "y")
    return full.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """node and its distinct shingles, sorted, as 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
            for low, high in chunks(offsets, CHUNK_BYTES, CHUNK_TEXTS):
                doc, found, _ = shingles(*word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
                cut = np.searchsorted(doc, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([found[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node and label of the buckets that hold several classes; of buckets with the same nodes only one."""
    labelled = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = F.xxhash64("node")
    held = labelled.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_n"), F.bit_xor(mixed).alias("_x"), F.min(mixed).alias("_min"), F.max(mixed).alias("_max"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("_y"))
    one = held.where("_low < _high").groupBy("_n", "_x", "_y", "_min", "_max").agg(F.min("bucket").alias("bucket")).select("bucket")
    return labelled.join(one, "bucket", "left_semi")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every document.

    A null text is a class of its own. Texts without a word are equal to each other and to no other. Rows that share
    a doc_id are one document, with the copies of each of its texts; near copies are sought for the text whose hash is the
    least. A null doc_id has a null class. Ties cannot be: a class is named by its least doc_id. A very long text is sketched
    alone, in memory that grows with its words. An empty table gives no rows. Columns beside doc_id and text are not read.
    """
    rows = materialise(sketch(docs), "sketches")
    content = materialise(rows.groupBy("content").agg(F.min("doc_id").alias("node")), "contents")
    held = rows.join(content.select(F.col("node").alias("doc_id"), "content"), ["doc_id", "content"], "left_semi")
    nodes = materialise(held.groupBy(F.col("doc_id").alias("node")).agg(F.min(F.struct("version", "content", "bands", "registers")).alias("r")).select("node", "r.version", "r.bands", "r.registers"), "nodes")
    hits = nodes.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
    leads = materialise(hits.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).where("lead < _last").drop("_last"), "leads")
    shared = materialise(hits.join(leads, "bucket"), "buckets")
    links, labels = None, None
    if not shared.isEmpty():
        wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "version")  # a lead is in its bucket itself
        texts = materialise(_versions(docs).withColumnRenamed("doc_id", "node").join(wanted, ["node", "version"], "left_semi").dropDuplicates(["node"]).select("node", "text"), "texts")
        stars = shared.groupBy("node").agg(F.min("lead").alias("a")).where("a < node").select("a", F.col("node").alias("b"))
        links = materialise(_verified(stars, texts), "links")
        labels = components(links)
        for compare in (_likely, _exact):
            active = materialise(_apart(shared, labels), "active")
            payload = nodes.select("node", "registers")
            if compare is _exact:
                payload = payload.join(_shingle_sets(texts.join(active.select("node").distinct(), "node", "left_semi")), "node")
            found = materialise(_blocks(active, payload, compare), "pairs")
            more = materialise(_verified(found, texts), "links") if compare is _likely else found
            if not more.isEmpty():
                links = links.union(more)
                labels = components(links)
    known = content if labels is None else content.join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("node"))
    found = rows.select("doc_id", "content").join(known, "content").groupBy("doc_id").agg(F.min("node").alias("class_id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
