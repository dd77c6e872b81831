"""Toxic passages by maximum-scoring segments (operator 4).

Words score their log-odds between toxic and other labelled documents under a Dirichlet prior, drawn towards
zero by their standard error; the same holds for families of words with the same first letters. A word seen in
n documents weighs its own log-odds by n / (n + prior) against its family's, so that an unseen form of a toxic
family still scores. A constant cost per word makes ordinary text drift down; one
linear scan then finds every maximal-scoring passage. The best score of a document of n words that is not
toxic follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves the moment equation
over the words of such documents, K is its maximum-likelihood value over them. Passages that the law finds
significant are added up, and a one-variable logistic curve over labelled documents turns that into a score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytelevel import chunks, letter_classes, letter_runs, text_buffer
from .shared import materialise, ship, worker_state

#: Buckets of the hashed word table. It alone is broadcast: 6 bytes each, compressed, whatever the size of the corpus.
BUCKETS = 1 << 21
FAMILY = 4  # letters of a word that name its family
PRIOR = 0.5  # the Dirichlet prior of each word and family, in documents
PRIOR_WORD = 5.0  # documents that a word must be in to weigh as much as its family
CAUTION = 2.0  # standard errors by which log-odds are drawn towards zero
COST = 1.0  # taken from each word's log-odds
LIMIT = 8.0  # log-odds are held within this many nats either way
SIGNIFICANT = 0.05  # passages with a smaller p-value in their document are reported
BINS = 400

_CLASSES = letter_classes()


def fold(doc_id: Column, of: int) -> Column:
    """The remainder of crc32(doc_id as text); a null id counts as 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(of))


def buckets_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of distinct words and of their families; FAMILY counts letters, not bytes."""
    values = words.to_pylist()
    own = np.fromiter((zlib.crc32(w) for w in values), np.int64, len(values)) % BUCKETS
    family = np.fromiter((zlib.crc32(b"\xff" + (w[:FAMILY] if w.isascii() else w.decode()[:FAMILY].encode())) for w in values), np.int64, len(values)) % BUCKETS
    return own, family


def _words(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(pc.utf8_lower(column))
    for low, high in chunks(offsets):
        yield low, high, *letter_runs(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], _CLASSES)


@dataclass
class Model:
    """By bucket: a family's log-odds, a word's (already weighted), and the weight left to its family. The rest calibrates."""

    family: np.ndarray
    word: np.ndarray
    rest: np.ndarray
    rate: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 1.0
    intercept: float = 0.0

    def packed(self) -> tuple[str, list[bytes]]:
        """The tables for a broadcast: compressed half floats under a name that is their digest."""
        parts = [zstandard.ZstdCompressor(level=3).compress(t.astype(np.float16).tobytes()) for t in (self.family, self.word, self.rest)]
        return hashlib.sha256(b"".join(parts)).hexdigest(), parts

    def scalars(self) -> tuple[float, float, float, float]:
        return self.rate, self.k, self.slope, self.intercept

    def scores(self, words: pa.Array) -> np.ndarray:
        own, family = buckets_of(words)
        return np.clip(self.word[own] + self.rest[own] * self.family[family], -LIMIT, LIMIT) - COST

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Every maximal-scoring passage (begin, end, score) of a document's word scores, in order.

        Words between two positive ones always stand together, so the scan steps over positive words only. Each
        new word looks back for the nearest passage that began lower, and joins it if that one also ended lower;
        a passage once absorbed is never met again, which keeps the scan linear.
        """
        positive = np.flatnonzero(scores > 0)
        if not len(positive):
            return []
        total = np.concatenate([np.zeros(1), np.cumsum(scores, dtype=np.float64)])
        open_: list[list] = []  # begin, end, sum before, sum after, nearest earlier one that began lower
        for at in positive.tolist():
            begin, end, before, after = at, at + 1, total[at], total[at + 1]
            j = len(open_) - 1
            while True:
                while j >= 0 and open_[j][2] >= before:
                    j = open_[j][4]
                if j < 0 or open_[j][3] >= after:
                    open_.append([begin, end, before, after, j])
                    break
                begin, before = open_[j][0], open_[j][2]
                previous = open_[j][4]
                del open_[j:]
                j = previous
        return [(b, e, float(y - x)) for b, e, x, y, _ in open_]

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the expected number of chance passages as good as the significant ones together."""
        n = max(n, 1)
        best = max((s for _, _, s in found), default=0.0)
        base = math.log(self.k * n)
        more = sum(max(0.0, self.rate * s - base) for _, _, s in found)
        return max(self.rate * best - base, more)

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.rate * score))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, self.slope * evidence + self.intercept))))


def unpacked(packed: tuple[str, list[bytes]], scalars: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.0)) -> Model:
    """The model on a worker, which keeps the tables of the last one."""
    name, parts = packed
    tables = worker_state(f"toxicity {name}", lambda: [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.float16).astype(np.float32) for p in parts])
    return Model(*tables, *scalars)


def learn(labelled: DataFrame, label_col: str = "toxic") -> Model:
    """Fit to documents with text and a 0/1 label. Without one of the two labels nothing is toxic.

    One pass counts hashed words by label, where each task sends a row per bucket it met; a second one fits the
    calibration from sums and a histogram. Nothing that reaches the driver grows with the corpus beyond BUCKETS.
    """
    spark = labelled.sparkSession
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity", dict)
        sums = np.zeros((2, 2, BUCKETS), np.int32)  # word or family, label, bucket; documents of one task
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high, words, index, at in _words(batch.column(0)):
                # a word counts once a document
                doc = np.repeat(np.arange(low, high), np.diff(at))
                for k, bucket in enumerate(buckets_of(words)):
                    pair = np.unique(doc * BUCKETS + bucket[index])
                    for y in (0, 1):
                        own = label[pair // BUCKETS] == y
                        np.add.at(sums[k, y], pair[own] % BUCKETS, 1)
        for k in (0, 1):
            bucket = np.flatnonzero(sums[k].any(axis=0))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(bucket), k, np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "other": pa.array(sums[k, 0, bucket].astype(np.int64)), "toxic": pa.array(sums[k, 1, bucket].astype(np.int64))})

    # read four times below; written once, so that the join that labels texts runs once
    rows = materialise(labelled.where("text is not null").select("text", F.col(label_col).cast("int").alias("label")).where("label in (0, 1)"), "labelled")
    calibrate = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    counted = rows.where(~calibrate).mapInArrow(count, "kind int, bucket int, other long, toxic long").groupBy("kind", "bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    sums = np.zeros((2, 2, BUCKETS))
    kind, bucket = counted["kind"].to_numpy(), counted["bucket"].to_numpy()
    for y, name in enumerate(("other", "toxic")):
        np.add.at(sums[:, y], (kind, bucket), counted[name].to_numpy())
    model = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32), intercept=-20.0)
    totals = sums[1].sum(axis=1)
    if not totals.all():
        return model
    odds = []
    for counts in sums:
        other, toxic = counts + PRIOR
        raw = np.log(toxic / other) - np.log(totals[1] / totals[0])
        odds.append(np.sign(raw) * np.maximum(0, np.abs(raw) - CAUTION * np.sqrt(1 / toxic + 1 / other)))
    many = sums[0].sum(axis=0)
    weight = many / (many + PRIOR_WORD)
    model.family[:] = odds[1]
    model.word[:] = odds[0] * weight
    model.rest[:] = 1 - weight
    _calibrate(rows.where(calibrate), model)
    return model


def _calibrate(rows: DataFrame, model: Model) -> None:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.packed())
    edges = np.linspace(-LIMIT - COST, LIMIT - COST, BINS + 1)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, m = np.zeros(BINS, np.int64), unpacked(shared.value)
        for batch in batches:
            other = batch.column(1).to_numpy(zero_copy_only=False) == 0
            for low, high, words, index, at in _words(batch.column(0)):
                many = np.bincount(index[np.repeat(other[low:high], np.diff(at))], minlength=len(words))
                if many.any():
                    sums += np.histogram(m.scores(words), edges, weights=many)[0].astype(np.int64)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(BINS, dtype=np.int32)), "n": pa.array(sums)})

    found = rows.mapInArrow(histogram, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect()
    weights = np.zeros(BINS)
    for b, n in found:
        weights[b] = n
    middle = (edges[1:] + edges[:-1]) / 2
    weights += (middle > 0) * 1e-6 * weights.sum() / (middle > 0).sum()  # a floor, so that lambda exists where no such word scores above zero
    weights /= weights.sum()
    low, high = 1e-3, 50.0
    if (weights * middle).sum() < 0:
        for _ in range(80):
            rate = (low + high) / 2
            value = (weights * np.exp(np.minimum(rate * middle, 600))).sum()
            low, high = (low, rate) if value > 1 else (rate, high)
    model.rate = min(low, 3.0)
    scalars = model.scalars()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0.0
        m = unpacked(shared.value, scalars)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for low, _, n, found in _documents(m, batch.column(0)):
                if labels[low] == 0:
                    docs += 1
                    total += max(n, 1) * math.exp(-m.rate * max((s for _, _, s in found), default=0.0))
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs]), "total": pa.array([total])})

    docs, total = rows.mapInArrow(tails, "docs double, total double").agg(F.sum("docs"), F.sum("total")).first()
    model.k = max(1e-6, docs / total) if total else 1.0
    fitted = model.scalars()

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, m = np.zeros((2, BINS), np.int64), unpacked(shared.value, fitted)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for low, _, n, found in _documents(m, batch.column(0)):
                sums[labels[low], _bin(m.evidence(found, n))] += 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(BINS, dtype=np.int32)), "other": pa.array(sums[0]), "toxic": pa.array(sums[1])})

    table = np.zeros((2, BINS))
    for b, other, toxic in rows.mapInArrow(evidence, "bin int, other long, toxic long").groupBy("bin").agg(F.sum("other"), F.sum("toxic")).collect():
        table[:, b] = other, toxic
    model.slope, model.intercept = _logistic(_centres(), table)
    shared.unpersist()


def _bin(x: float) -> int:
    return min(BINS - 1, max(0, int((x + 20) * BINS / 80)))


def _centres() -> np.ndarray:
    return (np.arange(BINS) + 0.5) * 80 / BINS - 20


def _logistic(x: np.ndarray, table: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps over a histogram, with a small ridge that keeps separable data finite."""
    n = table.sum(axis=0)
    beta = np.array([1.0, -5.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (table[1] - n * p) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
    return max(0.05, float(beta[0])), float(beta[1])


def _documents(model: Model, column: pa.Array) -> Iterator[tuple[int, np.ndarray, int, list[tuple[int, int, float]]]]:
    """Row, word scores, number of words and passages of each text."""
    for low, high, words, index, at in _words(column):
        scores = model.scores(words)[index]
        positive = np.concatenate([np.zeros(1, np.int64), np.cumsum(scores > 0)])
        any_ = positive[at[1:]] > positive[at[:-1]]
        for i in range(high - low):
            own = scores[at[i] : at[i + 1]]
            yield low + i, own, len(own), model.passages(own) if any_[i] else []


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_passages, worst (score of the best passage) and passages of every document.

    Null and empty texts have no passage and the score of an empty document. Rows are scored one by one: repeated
    rows alike, no documents none; columns beside doc_id and text are not read. passages holds the significant
    ones, as first word, end word and p-value.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, scalars = spark.sparkContext.broadcast(model.packed()), model.scalars()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpacked(shared.value, scalars)
        for batch in batches:
            out = ([], [], [], [], [])
            for _, _, n, found in _documents(m, batch.column(1)):
                significant = [{"begin": b, "end": e, "p_value": p} for b, e, s in found if (p := m.p_value(s, n)) <= SIGNIFICANT]
                p = m.probability(m.evidence(found, n))
                for column, value in zip(out, (p, int(p >= 0.5), len(significant), max((s for _, _, s in found), default=0.0), significant), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64()), pa.array(out[4], PASSAGES)], ["doc_id", "score", "predicted", "n_passages", "worst", "passages"])

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages int, worst double, passages array<struct<begin:int,end:int,p_value:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns kept, whose text is not predicted to be toxic. Each row is judged by its own text."""
    spark = docs.sparkSession
    ship(spark)
    shared, scalars = spark.sparkContext.broadcast(model.packed()), model.scalars()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpacked(shared.value, scalars)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, _, n, found in _documents(m, batch.column(place)):
                keep[row] = m.probability(m.evidence(found, n)) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


PASSAGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p_value", pa.float64())]))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled documents outside the held-out fold; a document labelled twice counts as toxic if either says so.

    The number of labels grows with the corpus, so the join is a merge at every size, never a broadcast.
    """
    train = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(train.hint("merge"), "doc_id").select("text", "toxic")
