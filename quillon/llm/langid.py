"""Language identification by error-correcting output codes (operator 7).

Every learned language has a codeword. One binary classifier per bit tells, from hashed byte n-grams, the
languages with that bit from those without. Decoding is loss-weighted: for each codeword the losses of the bits'
margins are summed, each weighted by how well that bit's classifier knows that language, and the language
with the least loss wins. A small gap to the second flags the document as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytelevel import chunks, text_buffer
from .shared import ship, smallest, worker_state
from .toxicity import fold

GRAM = 3  # bytes of an n-gram
BUCKETS = 1 << 16
PRIOR = 0.5  # added to each bucket's count
SHARPNESS = 24.0  # margins are mean log-odds per n-gram times this
AMBIGUOUS = 0.2  # least gap between the two best probabilities
#: Classifier weights of the decoding are measured on at most this many training documents, those with the
#: smallest hash of their text. The n-gram counts themselves come from all training documents.
WEIGHT_DOCS = 4000
UNKNOWN = "und"
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def codebook(k: int) -> np.ndarray:
    """k codewords of +-1 bits: all splits for few languages, else random ones with the best least distance of 40 drawn."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    bits, best, least = int(np.ceil(10 * np.log2(k))), None, -1
    draw = np.random.default_rng(7)
    for _ in range(40):
        code = np.where(draw.random((k, bits)) < 0.5, 1, -1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        distance = min(int((code[a] != code[b]).sum()) for a, b in itertools.combinations(range(k), 2))
        if distance > least:
            best, least = code, distance
    return best


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows low to high, the bucket of the n-gram at each place, and where each text's begin (n + 1).

    Texts are lower-cased and followed by spaces, so that a short text has n-grams too. None reaches into the next text: those
    that start in the spaces are BLANK.
    """
    folded = pc.binary_join_element_wise(pc.utf8_lower(column.fill_null("")), pa.scalar(" " * (GRAM - 1)), "")
    data, offsets = text_buffer(folded)
    for low, high in chunks(offsets, 4 << 20):
        part = np.append(data[offsets[low] : offsets[high]], np.full(GRAM - 1, 32, np.uint8))
        bucket = hashed(part)
        ends = offsets[low + 1 : high + 1] - offsets[low]
        for k in range(1, GRAM):
            bucket[ends - k] = BLANK
        yield low, high, bucket, offsets[low : high + 1] - offsets[low]


def hashed(data: np.ndarray) -> np.ndarray:
    """The bucket of each n-gram of bytes."""
    part = data.astype(np.uint32)
    n = len(part) - GRAM + 1
    mixed = part[:n] * _MULTIPLY[0]
    for k in range(1, GRAM):
        mixed += part[k : n + k] * _MULTIPLY[k]
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2654435769)
    return (mixed >> np.uint32(16)).astype(np.int32)


#: The bucket of spaces alone, which say nothing of a language.
BLANK = int(hashed(np.full(GRAM, 32, np.uint8))[0])


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bits x buckets
    weight: np.ndarray  # languages x bits, each row sums to 1

    def margins(self, bucket: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x bits. Every text has at least GRAM - 1 n-grams."""
        size = np.diff(offsets)
        out = np.stack([np.add.reduceat(w[bucket], offsets[:-1]) for w in self.odds], axis=1)
        return SHARPNESS * out / size[:, None]

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Texts x languages, from the weighted logistic losses of each codeword."""
        loss = np.stack([(w * np.logaddexp(0, -np.clip(margins * c, -60, 60))).sum(axis=1) for w, c in zip(self.weight, self.code, strict=True)], axis=1)
        scaled = -loss * np.sqrt(self.code.shape[1])
        scaled -= scaled.max(axis=1, keepdims=True)
        e = np.exp(scaled)
        return e / e.sum(axis=1, keepdims=True)


def learn(labelled: DataFrame) -> Model | None:
    """Fit to rows of text and lang, both not null; None where there is no such row.

    Tasks count n-grams by language over all rows and send non-zero counts; at most languages x BUCKETS rows reach the driver.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for low, high, bucket, offsets in grams(batch.column(0)):
                each = np.repeat(code[low:high], np.diff(offsets))
                for k in np.unique(code[low:high]):
                    found = np.bincount(bucket[: len(each)][each == k], minlength=BUCKETS)
                    sums[names[k]] = sums.get(names[k], 0) + found
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(found[at])})

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    languages = sorted(pc.unique(counted["lang"]).to_pylist())
    place = {x: k for k, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), PRIOR)
    coded = pc.dictionary_encode(counted["lang"]).combine_chunks()
    lang = np.array([place[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    table[lang, counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    table /= table.sum(axis=1, keepdims=True)
    code = codebook(len(languages))
    odds = np.zeros((code.shape[1], BUCKETS), np.float32)
    for b in range(code.shape[1]):
        if (code[:, b] == -1).any():
            odds[b] = np.log(table[code[:, b] == 1].mean(axis=0) / table[code[:, b] == -1].mean(axis=0))
        else:
            odds[b] = 1.0
    odds[:, BLANK] = 0.0
    model = Model(languages, code, odds, np.full(code.shape, 1 / code.shape[1]))
    sample = smallest(rows, F.xxhash64("text"), WEIGHT_DOCS).toArrow().combine_chunks()
    truth = np.array([place[x] for x in sample["lang"].to_pylist()])
    right, seen = np.ones(code.shape), np.full((len(languages), 1), 2.0)
    for batch in sample.to_batches():
        for low, high, bucket, offsets in grams(batch.column(0)):
            hit = (np.sign(model.margins(bucket, offsets)) == code[truth[low:high]]).astype(float)
            np.add.at(right, truth[low:high], hit)
            np.add.at(seen, truth[low:high], 1.0)
        truth = truth[batch.num_rows :]
    accuracy = right / seen
    model.weight = accuracy / accuracy.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, second (the next language) and ambiguous of every document.

    A null text, or one without a letter, is `und` with score 0, as is every text where nothing was learned. Rows are
    predicted one by one; columns beside doc_id and text are not read. Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("languages", dict)
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, second, score, gap = np.full(n, UNKNOWN, object), np.full(n, None, object), np.zeros(n), np.zeros(n)
            if m is not None and n:
                letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names = np.array(m.languages, object)
                for low, high, bucket, offsets in grams(batch.column(1)):
                    p = m.probabilities(m.margins(bucket, offsets))
                    order = np.argsort(-p, axis=1, kind="stable")
                    row = np.arange(high - low)
                    top = p[row, order[:, 0]]
                    has = letters[low:high]
                    lang[low:high][has] = names[order[:, 0]][has]
                    score[low:high][has] = top[has]
                    if len(names) > 1:
                        second[low:high][has] = names[order[:, 1]][has]
                        gap[low:high] = top - p[row, order[:, 1]]
                    else:
                        gap[low:high] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(gap < AMBIGUOUS)], ["doc_id", "lang_pred", "score", "second", "ambiguous"])

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, second string, ambiguous boolean"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of the documents outside the held-out fold."""
    return docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
