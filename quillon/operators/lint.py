"""The linter of rule questions: one JSON text a row in, the codes of its faults out; and the faults of groups of three variants.

A row is read as a variant once. Each rule is a pair of a code and how often it is broken, so an item's fault counts once an item. Rules of
later fields don't run where the row, or its answer, is no object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .validate import codes

# The allowed words and the forms of ids.
SCOPES, KINDS, SOURCES = ["general", "class"], ["boolean", "text", "short_list"], ["guideline", "general_knowledge"]
GROUP_FORM, VARIANT_FORM = r"^(?:GEN_\d+|LBL_[A-Z0-9_]+_\d+)$", r"^(.+)_v([1-9]\d*)$"
LONGEST, MOST_ITEMS = 20, 5

_ROW = "_row"


def _at(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(_ROW), f"$.{path}", kind)


def _kind(value: Column) -> Column:
    """The JSON type of a variant: OBJECT<...>, ARRAY<...>, STRING, BIGINT, BOOLEAN, VOID and so on; null for what is absent."""
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _text(path: str) -> Column:
    return F.coalesce(X.collapse(_at(path, "string")), F.lit(""))


def _list(path: str) -> Column:
    return F.when(_is(_at(path), "ARRAY"), _at(path, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _words(items: Column) -> Column:
    """The filled texts among variants."""
    return F.filter(F.transform(items, lambda x: F.coalesce(X.collapse(F.try_variant_get(x, "$", "string")), F.lit(""))), lambda x: x != "")


def _times(items: Column, broken) -> Column:
    return F.size(F.filter(items, lambda x: F.coalesce(broken(x), F.lit(False))))


def parsed(df: DataFrame, line: str = "line") -> DataFrame:
    """df with the line as a variant and the fields that rules of rows and groups read."""
    rows = df.withColumn(_ROW, F.try_parse_json(F.col(line)))
    answer = _at("answer.correct_answer")
    options = _words(_list("answer.answer_options"))
    raw = F.when(_is(answer, "ARRAY"), _words(_at("answer.correct_answer", "array<variant>"))).otherwise(F.filter(F.transform(F.split(F.coalesce(_at("answer.correct_answer", "string"), F.lit("")), "[,\n]"), X.collapse), lambda x: x != ""))
    lower = F.transform(raw, F.lower)
    items = F.filter(F.transform(raw, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_position(lower, F.lower(p["x"])) == p["i"] + 1)
    return rows.withColumns({f"_{name}": _text(f"answer.{name}") for name in ("task_type", "source_type", "answer_type", "scope", "label", "group_id", "variant_id", "evidence_path")} | {"_options": options, "_items": F.transform(items, lambda p: p["x"]), "_truth": F.when(_is(answer, "ARRAY"), "").otherwise(_text("answer.correct_answer")), "_prompt": F.when(_is(_at("prompt"), "STRING"), X.strip(_at("prompt", "string"))).otherwise("")})


def _flag(name: str) -> Column:
    return F.col(f"_{name}")


def truth_key() -> Column:
    """What the answers of a group's rows must agree in; null where the answer is not readable."""
    flag = X.yes_no(F.coalesce(_at("answer.correct_answer", "string"), F.lit("")))
    listed = F.array_join(F.transform("_items", F.lower), ",")
    return F.nullif(F.when(_flag("answer_type") == "boolean", flag).when(_flag("answer_type") == "text", F.lower("_truth")).when(_flag("answer_type") == "short_list", listed), F.lit(""))


def row_codes(lines: Column | None = None) -> Column:
    """The codes of a parsed row's faults in order, one an occurrence (V-03). ``lines``: how many lines the evidence's file has, if known."""
    row, answer, meta = F.col(_ROW), _at("answer"), _at("meta")
    n = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    kind, scope, label, group, variant, path = (_flag(x) for x in ("answer_type", "scope", "label", "group_id", "variant_id", "evidence_path"))
    options, lower = F.col("_options"), F.transform("_options", F.lower)
    tags = _words(_list("answer.tags"))
    evidence = _list("answer.evidence")
    items = F.col("_items")
    boolean, text, short = (kind == k for k in KINDS)
    flag = X.yes_no(F.coalesce(_at("answer.correct_answer", "string"), F.lit("")))
    lacks = lambda x: (F.size(options) > 0) & ~F.array_contains(lower, F.lower(x))
    source = lambda e: F.coalesce(X.collapse(F.try_variant_get(e, "$.source", "string")), F.lit(""))
    own_lines = lambda e: F.try_variant_get(e, "$.lines", "variant")
    objects = F.filter(evidence, lambda e: _is(e, "OBJECT"))
    listed = F.filter(objects, lambda e: own_lines(e).isNull() | _is(own_lines(e), "ARRAY"))
    numbers = F.flatten(F.transform(listed, lambda e: F.transform(F.coalesce(F.try_variant_get(e, "$.lines", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.struct(x.alias("x"), source(e).alias("source")))))
    whole = lambda x: _is(x, "BIGINT")
    value = lambda x: F.try_variant_get(x, "$", "long")
    other = lambda name, field: n((_text(f"meta.{name}") != "") & (field != "") & (_text(f"meta.{name}") != field))
    batch = _at("meta.batch_index")
    rules = {
        "missing_or_empty_prompt": n(_flag("prompt") == ""),
        "prompt_missing_answer_tag_hint": n((_flag("prompt") != "") & ~F.contains("_prompt", F.lit("<answer>"))),
        "missing_or_invalid_answer_obj": n(~_is(answer, "OBJECT")),
    }
    deep = {
        "missing_or_invalid_meta_obj": n(~_is(meta, "OBJECT")),
        "task_type_not_text_rule": n(_flag("task_type") != "text_rule"),
        "source_type_not_text_rule": n(_flag("source_type") != "text_rule"),
        "invalid_scope": n(~scope.isin(SCOPES)),
        "general_scope_with_label": n((scope == "general") & (label != "")),
        "class_scope_without_label": n((scope == "class") & (label == "")),
        "invalid_answer_type": n(~kind.isin(KINDS)),
        "missing_group_id": n(group == ""),
        "missing_variant_id": n(variant == ""),
        "variant_id_group_prefix_mismatch": n((group != "") & (variant != "") & ~variant.startswith(F.concat(group, F.lit("_v")))),
        "variant_id_pattern_invalid": n((group != "") & (variant != "") & (F.regexp_extract(variant, VARIANT_FORM, 1) != group)),
        "group_id_pattern_invalid": n((group != "") & ~group.rlike(GROUP_FORM)),
        "answer_options_not_list": n(_at("answer.answer_options").isNotNull() & ~_is(_at("answer.answer_options"), "ARRAY")),
        "boolean_correct_answer_invalid": n(boolean & flag.isNull()),
        "boolean_answer_options_missing_yes_no": n(boolean & (F.size(options) > 0) & ~(F.array_contains(lower, "yes") & F.array_contains(lower, "no"))),
        "text_answer_options_empty": n(text & (F.size(options) == 0)),
        "text_correct_answer_is_list": n(text & _is(_at("answer.correct_answer"), "ARRAY")),
        "text_correct_answer_empty": n(text & (_flag("truth") == "")),
        "text_correct_answer_too_long": n(text & (X.token_count(_flag("truth")) > LONGEST)),
        "text_correct_answer_not_in_options": n(text & (_flag("truth") != "") & lacks(_flag("truth"))),
        "short_list_answer_options_empty": n(short & (F.size(options) == 0)),
        "short_list_correct_answer_empty": n(short & (F.size(items) == 0)),
        "short_list_correct_answer_too_many_items": n(short & (F.size(items) > MOST_ITEMS)),
        "short_list_item_too_long": F.when(short, _times(items, lambda x: X.token_count(x) > LONGEST)).otherwise(0),
        "short_list_item_not_in_options": F.when(short, _times(items, lacks)).otherwise(0),
        "tags_not_list": n(_at("answer.tags").isNotNull() & ~_is(_at("answer.tags"), "ARRAY")),
        "tags_missing_family": n((group != "") & ~F.array_contains(tags, F.concat(F.lit("family:"), group))),
        "tags_missing_variant": n((variant != "") & ~F.array_contains(tags, F.concat(F.lit("variant:"), variant))),
        "evidence_missing_or_empty": n(F.size(evidence) == 0),
        "evidence_item_not_object": F.size(evidence) - F.size(objects),
        "invalid_evidence_source": _times(objects, lambda e: ~source(e).isin(SOURCES)),
        "evidence_lines_not_list": F.size(objects) - F.size(listed),
        "evidence_lines_empty": _times(listed, lambda e: F.coalesce(F.size(F.try_variant_get(e, "$.lines", "array<variant>")), F.lit(0)) <= 0),
        "evidence_line_not_int": _times(numbers, lambda x: ~whole(x["x"])),
        "evidence_line_not_positive": _times(numbers, lambda x: whole(x["x"]) & (value(x["x"]) <= 0)),
        "evidence_line_out_of_guideline_range": _times(numbers, lambda x: whole(x["x"]) & (x["source"] == "guideline") & (path != "") & (value(x["x"]) > (lines if lines is not None else F.lit(None).cast("long")))),
        "evidence_path_missing": n(path == ""),
        "meta_source_type_mismatch": other("source_type", _flag("source_type")),
        "meta_sample_id_mismatch": other("sample_id", variant),
        "meta_family_mismatch": other("family", group),
        "origin_guideline_evidence_path_mismatch": other("origin_guideline", path),
        "invalid_batch_index": n(batch.isNotNull() & ~(whole(batch) & F.coalesce(_at("meta.batch_index", "long") > 0, F.lit(False)))),
        "missing_batch_index": n(batch.isNull()),
    }
    repeated = lambda table: [F.array_repeat(F.lit(code), times) for code, times in table.items()]
    none = F.array().cast("array<string>")
    inner = F.when(_is(answer, "OBJECT"), F.concat(*repeated(deep))).otherwise(none)
    return F.when(row.isNull(), F.array(F.lit("invalid_json_line"))).when(~_is(row, "OBJECT"), F.array(F.lit("non_object_row"))).otherwise(F.concat(*repeated(rules), inner))


def group_codes(rows: DataFrame) -> DataFrame:
    """group_id, rows and codes of each group of parsed rows whose answer is an object (V-02, V-04, A-17).

    One map-side aggregation: distinct values are counted, never listed; of the variants only those that end in _v1 to _v3, or not, matter.
    """
    number = F.regexp_extract("_variant_id", VARIANT_FORM, 2)
    own = rows.where(_is(_at("answer"), "OBJECT") & (F.col("_group_id") != ""))
    per = own.groupBy(F.col("_group_id").alias("group_id")).agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.nullif("_variant_id", F.lit(""))).alias("_variants"),
        F.count_distinct("_scope").alias("_scopes"),
        F.count_distinct("_label").alias("_labels"),
        F.count_distinct("_answer_type").alias("_kinds"),
        F.count_distinct(truth_key()).alias("_truths"),
        F.count_distinct(F.to_json("_options")).alias("_optionses"),
        F.count_distinct(F.when(number.isin("1", "2", "3"), number)).alias("_known"),
        F.count_if((number != "") & ~number.isin("1", "2", "3")).alias("_others"),
    )
    rules = {"groups_not_3_rows": F.col("rows") != 3, "groups_not_3_variants": (F.col("_variants") != 3) & (F.col("_variants") > 0), "groups_scope_conflict": F.col("_scopes") > 1, "groups_label_conflict": F.col("_labels") > 1, "groups_answer_type_conflict": F.col("_kinds") > 1, "groups_correct_answer_conflict": F.col("_truths") > 1, "groups_answer_options_conflict": F.col("_optionses") > 1, "groups_variant_suffix_not_exact_v1_v2_v3": (F.col("_variants") > 0) & ((F.col("_known") != 3) | (F.col("_others") > 0))}
    return per.select("group_id", "rows", codes(rules).alias("codes"))


def repeats(rows: DataFrame) -> DataFrame:
    """code and n: how many prompts, and how many variant ids, more than one row has (V-04)."""
    def repeated(column: str, code: str, own: DataFrame) -> DataFrame:
        return own.where(F.col(column) != "").groupBy(column).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")

    with_answer = rows.where(_is(_at("answer"), "OBJECT"))
    return repeated("_prompt", "duplicate_prompt_count", rows.where(_is(F.col(_ROW), "OBJECT"))).unionByName(repeated("_variant_id", "duplicate_variant_id_count", with_answer))
