"""Data quality: rules as (code, broken) pairs, checked in one pass over the rows or the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def codes(rules: dict[str, Column]) -> Column:
    """The codes of all broken rules, in their order (V-02, V-03); a rule that is null isn't broken."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def row_rules(prompt: Column, answer: Column, ident: Column, pattern: str) -> dict[str, Column]:
    """Rules that hold for any row: filled fields, sizes, an id of the right form (V-03, V-07)."""
    return {
        "prompt_missing": F.coalesce(X.strip(prompt), F.lit("")) == "",
        "prompt_long": X.token_count(prompt) > 200,
        "answer_missing": F.coalesce(X.strip(answer), F.lit("")) == "",
        "answer_edges": answer != X.strip(answer),
        "answer_in_prompt": (F.length(answer) >= 40) & F.contains(prompt, answer),
        "id_form": ~F.coalesce(ident.rlike(pattern), F.lit(False)),
    }


def group_rules(df: DataFrame, group: str, value: str, variant: str, size: int) -> DataFrame:
    """group, rows and the codes of broken group rules: size, agreement, missing and repeated variants (V-04, A-17)."""
    per = df.groupBy(group).agg(F.count("*").alias("rows"), F.count_distinct(value).alias("_values"), F.count_distinct(variant).alias("_variants"))
    return per.select(group, "rows", codes({"group_size": F.col("rows") != size, "value_conflict": F.col("_values") > 1, "variant_missing": F.col("_variants") < size, "variant_repeated": F.col("_variants") < F.col("rows")}).alias("codes"))


def duplicates(df: DataFrame, column: str, key: str, examples: int) -> DataFrame:
    """Values that occur more than once, how often, and their first keys (A-18).

    The least keys are kept by nested top-n aggregation, never the whole list of a hot value.
    """
    many = df.groupBy(column).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    return many if examples <= 1 else many.join(df.select(column, key), column).groupBy(column, "n", "first").agg(F.min(F.when(F.col(key) > F.col("first"), F.col(key))).alias("second"))


def leaks(question: Column, answer: Column, labels: list[str], keywords: str) -> Column:
    """Whether a question names a diagnosis by a keyword, or question or answer hold a label (C-10)."""
    both = X.alnum(F.concat_ws(" ", question, answer))
    phrase = F.exists(F.array(*[F.lit(f" {label} ") for label in labels]), lambda p: F.contains(F.concat(F.lit(" "), both, F.lit(" ")), p))
    return F.lower(question).rlike(keywords) | phrase


def quotes(text: Column, lines: Column, least: int = 40) -> Column:
    """Whether the text holds a long line of the evidence word for word (C-11)."""
    return F.exists(lines, lambda x: (F.length(X.folded(x)) >= least) & F.contains(X.folded(text), X.folded(x)))


def outside(lines: Column, first: int, last: int) -> Column:
    """Whether any line number lies outside the range (C-12, V-05)."""
    return F.exists(lines, lambda n: (n < first) | (n > last))


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df, failing at run time on a row that breaks the rule (V-06)."""
    return df.where(F.assert_true(holds, F.lit(message)).isNull())
