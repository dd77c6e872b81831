"""Quality rules with risk-controlled cutoffs (operator 2), in DataFrame expressions only.

A base rule drops very short and very repetitive texts. Beyond it, each rule rejects documents whose feature is
above a cutoff of their stratum (language). Cutoffs come from labelled documents that pass the base rule: for
each stratum and rule the cutoffs of a fixed grid are tested from the most lenient on, and a cutoff is certified if the
exact binomial tail at the observed number of rejected good documents refutes a false-rejection rate above
ALPHA / rules. Testing in that fixed order stops at the first failure, which needs no correction within a
rule; the error level is divided by the number of strata and rules (Bonferroni). So with probability
1 - DELTA no stratum loses more than ALPHA of its good documents. Among certified cutoffs the one with most
rejected bad documents wins, where a rejected good one counts against PENALTY bad ones.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
ALPHA, DELTA, PENALTY = 0.05, 0.05, 20
#: Rules: feature -> cutoffs, most lenient first.
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_line_share": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
    "repeat_share": [0.2, 0.18, 0.15, 0.12, 0.1],
    "mean_word_chars": [40.0, 30.0, 25.0, 20.0, 15.0, 12.0],
}
#: The columns that features() adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: it is bound as the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Equal ones become neighbours by sorting (hash, place); the places are
    then sorted again and each covers WINDOW words, less what the next one covers. Texts without a repeat, the
    most, stop at comparing the number of distinct hashes.
    """
    places = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), places), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(pairs: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["h"]) == x["h"]
            after = F.get(pairs, i + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        at = F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))
        return _let(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, covered))

    return F.when(places < 2, F.lit(0)).otherwise(_let(hashes, count))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and n_lines; a null text has none of anything.

    Existing columns of these names are replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACES}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    kept = [c for c in docs.columns if c not in {*BASE, "n_lines", "_w", "_l"}]
    staged = docs.select(*[F.col(f"`{c}`") for c in kept], by_words.alias("_w"), by_lines.alias("_l"), symbols.alias("n_symbols"))
    return staged.select(*[F.col(f"`{c}`") for c in kept], "_w.*", "_l.*", "n_symbols")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The feature of each rule of GRID."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"), "mean_word_chars": part("word_chars", "n_words")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly: the regularised incomplete beta function I_{1-p}(n - k, k + 1)."""
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    value: float
    good: int
    good_rejected: int
    bad_rejected: int


def certify(counts: dict[tuple[str, str, int, int], int], grid: dict[str, list[float]] = GRID, alpha: float = ALPHA, delta: float = DELTA, penalty: float = PENALTY) -> list[Cutoff]:
    """Cutoffs from counts by (stratum, rule, number of cutoffs that the document exceeds, label).

    A document with number j is rejected by the j most aggressive cutoffs of its rule, the last j of the grid.
    """
    strata = sorted({s for s, *_ in counts})
    out = []
    for s in strata:
        for rule, cutoffs in grid.items():
            good = sum(counts.get((s, rule, j, 1), 0) for j in range(len(cutoffs) + 1))
            best = None
            for place, value in enumerate(cutoffs):
                over = range(len(cutoffs) - place, len(cutoffs) + 1)
                lost, caught = (sum(counts.get((s, rule, j, y), 0) for j in over) for y in (1, 0))
                if not good or binomial_tail(lost, good, alpha / len(grid)) > delta / (len(strata) * len(grid)):
                    break
                gain = caught - penalty * lost
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, Cutoff(s, rule, value, good, lost, caught))
            if best:
                out.append(best[1])
    return out


def judge(featured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Add base_failed, kept and cutoffs' verdict ``rejected_by`` (the first rule that rejects, or null).

    featured: the (materialised) result of features(). Labelled documents calibrate; a document that is labelled
    twice counts with its lower quality, labels other than 0 and 1 don't count. A null stratum is the stratum ''.
    What reaches the driver is a count for each stratum, rule, grid place and label. Without labels, or with too
    few in a stratum, nothing is certified there and only the base rule rejects.
    """
    spark = featured.sparkSession
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit(""))
    marked = featured.withColumn("base_failed", base_failed())
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
    over = [reduce(operator.add, [F.when(x > v, 1).otherwise(0) for v in GRID[rule]]) for rule, x in shares().items()]
    rules = F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in GRID]).alias("rule"), F.array(*over).alias("place")))
    sample = marked.where(~F.col("base_failed")).join(marks, F.col(f"`{id_col}`") == F.col("_id")).select(stratum.alias("s"), "_quality", rules.alias("r"))
    counts = {(r[0], r[1], r[2], r[3]): r[4] for r in sample.groupBy("s", F.col("r.rule"), F.col("r.place"), "_quality").count().collect()}
    found = certify(counts)
    table: dict[str, dict[str, float]] = {}
    for c in found:
        table.setdefault(c.stratum, {})[c.rule] = c.value
    names = list(GRID)
    cutoffs = spark.createDataFrame([(s, [v.get(r) for r in names]) for s, v in table.items()], "_stratum string, _cutoffs array<double>")
    joined = marked.join(cutoffs, stratum == F.col("_stratum"), "left")
    by = F.coalesce(*[F.when(x > F.get(F.col("_cutoffs"), F.lit(k)), F.lit(rule)) for k, (rule, x) in enumerate(shares().items())])
    by = F.when(F.col("base_failed"), F.lit("base")).otherwise(by)
    return joined.withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull()).drop("_stratum", "_cutoffs")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by of every document.

    A null or empty text has no words and fails the base rule; repeated rows are judged alike; no documents give no rows.
    """
    featured = materialise(features(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    return judge(featured, labels).select("doc_id", *BASE, "base_failed", "kept", "rejected_by")
