"""Row rewrites: raw items to prompts, choices to open answers, messages, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

OPTIONS = ["option_A", "option_B", "option_C", "option_D"]


def base_rows(items: DataFrame, types: list[str] | None = None, options: tuple[int, int] = (2, 4)) -> DataFrame:
    """Raw question-answer items as rows of prompt, images and answer (P-04..P-06, C-01..C-03)."""
    opts = [F.col(c) for c in OPTIONS]
    n = X.option_count(opts)
    has = reduce(lambda a, b: a & b, [X.strip(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("question", "gt_answer", "image_path")])
    kept = items.where(has & n.between(*options))
    if types:
        kept = kept.where(F.col("question_type").isin(*types))
    gid = X.group_id(F.col("dataset"), [F.lit(None).cast("string")], F.col("image_path"))
    answer = F.struct(X.collapse(F.col("gt_answer")).alias("label"), X.answer_letter(opts, F.col("gt_answer")).alias("answer_id"), "question_id", "dataset", "question_type", gid["id"].alias("group_id"), gid["source"].alias("group_id_source"), *OPTIONS)
    return kept.select(X.choice_prompt(F.col("question"), opts).alias("prompt"), F.array("image_path").alias("images"), answer.alias("answer"))


def optionless(rows: DataFrame, label: str, group: Column, question: Column, clean: bool = True) -> DataFrame:
    """Choices rewritten to open answers (P-08, A-15, J-04): the labels of a row's group become its candidates.

    Vocabularies are one row a group and much smaller than the rows; the plain join lets the planner broadcast them
    by their measured size.
    """
    named = rows.withColumn("_group", group).withColumn("_label", X.clean_label(F.col(label)) if clean else F.col(label))
    vocabulary = named.where("_label <> ''").groupBy("_group").agg(F.sort_array(F.collect_set("_label")).alias("candidate_labels"))
    joined = named.where("_label <> ''").join(vocabulary, "_group")
    return joined.withColumn("prompt", X.open_prompt(question, F.col("candidate_labels"))).withColumnRenamed("_label", "correct_label").withColumnRenamed("_group", "optionless_group_key")


def messages(prompt: Column, marker: str = "<image>") -> Column:
    """Text and media parts in order, blank text left out (P-18)."""
    parts = F.split(prompt, marker)
    flat = F.flatten(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")), F.array(F.struct(F.lit("text").alias("type"), p.alias("text"))))))
    return F.filter(flat, lambda m: (m["type"] == "image") | (X.strip(m["text"]) != ""))


def fill_template(template: str, content: Column, slot: str = "{{ content }}") -> Column:
    """P-19."""
    return F.replace(F.lit(template), F.lit(slot), X.strip(content))


def think_variants(prompt: Column, reasoning: str, direct: str) -> Column:
    """Two prompts of one: with and without a reasoning instruction (P-11)."""
    return F.array(F.concat(prompt, F.lit(reasoning)), F.concat(prompt, F.lit(direct)))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty (P-21, Q-24)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def resolved(paths: Column, root: str) -> Column:
    """Absolute paths stay, others are put under the root (P-20)."""
    return F.transform(paths, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)))


def relative(paths: Column) -> Column:
    """Leading slashes off (P-13)."""
    return F.transform(paths, lambda p: F.regexp_replace(p, "^/+", ""))


def letter_rewrite(prompt: Column, tail: str = "Answer with one letter inside <answer></answer>.") -> Column:
    """A prompt whose last answer instruction is replaced, or appended where there is none (P-07)."""
    pattern = r"(?is)\s*(?:please\s+)?answer\b[^\n]*$"
    return F.when(prompt.rlike(pattern), F.concat(F.regexp_replace(prompt, pattern, "\n"), F.lit(tail))).otherwise(F.concat(X.strip(prompt), F.lit("\n" + tail)))


def two_stage_prompt(prompt: Column, eval_id: Column, keys: Column) -> Column:
    """An id, the keys to fill and an example in front; old answer tags removed (P-17)."""
    example = F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.lit("label")))))
    return F.concat(F.lit("[eval_id="), eval_id.cast("string"), F.lit("]\nFirst give "), example, F.lit("\n"), X.strip(F.regexp_replace(prompt, "(?is)</?answer>", "")))


def repaired_answer(raw: Column) -> tuple[Column, Column]:
    """(text, kind) of a field that holds raw JSON of any type (V-01): lists joined, null empty, others as text."""
    items = F.from_json(raw, "array<string>")
    kind = F.when(raw.isNull() | (raw == "null"), "null").when(raw.startswith("["), "list").when(raw.startswith('"'), "string").when(raw.startswith("{"), "object").otherwise("scalar")
    text = F.when(kind == "null", "").when(kind == "list", F.array_join(items, ", ")).when(kind == "string", F.regexp_replace(raw, '^"|"$', "")).otherwise(raw)
    return text, kind
