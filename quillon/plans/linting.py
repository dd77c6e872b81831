"""Queries over the linter of rule questions. Every part is a row with one planted fault, so the SQL knows its codes."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from ..operators import lint as L
from .registry import query
from .views import table

_GOOD = {
    "prompt": "Is it? <answer></answer>",
    "answer": {"task_type": "text_rule", "source_type": "text_rule", "answer_type": "boolean", "scope": "general", "label": None, "group_id": "GEN_1", "variant_id": "GEN_1_v1", "answer_options": ["Yes", "No"], "correct_answer": "yes", "tags": ["family:GEN_1", "variant:GEN_1_v1"], "evidence": [{"source": "guideline", "lines": [1, 2]}], "evidence_path": "g.txt"},
    "meta": {"source_type": "text_rule", "sample_id": "GEN_1_v1", "family": "GEN_1", "origin_guideline": "g.txt", "batch_index": 1},
}
_TEXT = {"answer.answer_type": "text", "answer.answer_options": ["Red spot", "blue"], "answer.correct_answer": "red  spot"}
_LIST = {"answer.answer_type": "short_list", "answer.answer_options": ["a", "b"], "answer.correct_answer": "A, b\na"}
_GONE = object()


def _changed(**changes) -> str:
    row = copy.deepcopy(_GOOD)
    for path, value in changes.items():
        *where, last = path.split(".")
        at = row
        for k in where:
            at = at[k]
        if value is _GONE:
            del at[last]
        else:
            at[last] = value
    return json.dumps(row)


def _cases() -> list[tuple[str, str]]:
    """(line, codes): each rule broken once, and rows that break none."""
    long_ = " ".join(["w"] * 21)
    one = lambda code, base=(), **changes: (_changed(**{**dict(base), **changes}), code)
    return [
        ("{oops", "invalid_json_line"), ("[1]", "non_object_row"), (_changed(), ""), (_changed(**_TEXT), ""), (_changed(**_LIST), ""),
        one("missing_or_empty_prompt", prompt="  "), one("missing_or_empty_prompt", prompt=4), one("prompt_missing_answer_tag_hint", prompt="Is it?"),
        one("missing_or_invalid_answer_obj", answer="x"), one("missing_or_invalid_meta_obj,missing_batch_index", meta=[1]),
        one("task_type_not_text_rule", **{"answer.task_type": "other"}), one("source_type_not_text_rule,meta_source_type_mismatch", **{"answer.source_type": "other"}),
        one("invalid_scope", **{"answer.scope": "x"}), one("general_scope_with_label", **{"answer.label": "nv"}), one("class_scope_without_label", **{"answer.scope": "class"}), one("", **{"answer.scope": "class", "answer.label": "nv"}),
        one("invalid_answer_type", **{"answer.answer_type": "number"}),
        one("missing_group_id", **{"answer.group_id": ""}), one("missing_variant_id", **{"answer.variant_id": _GONE}),
        one("variant_id_group_prefix_mismatch,variant_id_pattern_invalid,tags_missing_variant,meta_sample_id_mismatch", **{"answer.variant_id": "GEN_2_v1"}),
        one("variant_id_pattern_invalid,tags_missing_variant,meta_sample_id_mismatch", **{"answer.variant_id": "GEN_1_v0"}),
        one("group_id_pattern_invalid", **{"answer.group_id": "gen_1", "answer.variant_id": "gen_1_v1", "answer.tags": ["family:gen_1", "variant:gen_1_v1"], "meta.sample_id": "gen_1_v1", "meta.family": "gen_1"}),
        one("answer_options_not_list", **{"answer.answer_options": "Yes"}), one("boolean_correct_answer_invalid", **{"answer.correct_answer": "maybe"}), one("", **{"answer.correct_answer": True}),
        one("boolean_answer_options_missing_yes_no", **{"answer.answer_options": ["yes"]}),
        one("text_answer_options_empty", _TEXT, **{"answer.answer_options": []}), one("text_correct_answer_is_list,text_correct_answer_empty", _TEXT, **{"answer.correct_answer": ["blue"]}), one("text_correct_answer_empty", _TEXT, **{"answer.correct_answer": " "}),
        one("text_correct_answer_too_long,text_correct_answer_not_in_options", _TEXT, **{"answer.correct_answer": long_}), one("text_correct_answer_not_in_options", _TEXT, **{"answer.correct_answer": "green"}),
        one("short_list_answer_options_empty", _LIST, **{"answer.answer_options": []}), one("short_list_correct_answer_empty", _LIST, **{"answer.correct_answer": []}),
        one("short_list_correct_answer_too_many_items,short_list_item_not_in_options,short_list_item_not_in_options,short_list_item_not_in_options,short_list_item_not_in_options", _LIST, **{"answer.correct_answer": "a,b,c,d,e,f"}),
        one("short_list_item_too_long,short_list_item_not_in_options", _LIST, **{"answer.correct_answer": ["a", long_]}),
        one("tags_not_list,tags_missing_family,tags_missing_variant", **{"answer.tags": "x"}), one("tags_missing_family", **{"answer.tags": ["variant:GEN_1_v1"]}), one("tags_missing_variant", **{"answer.tags": ["family:GEN_1"]}),
        one("evidence_missing_or_empty", **{"answer.evidence": []}), one("evidence_item_not_object", **{"answer.evidence": [3]}), one("invalid_evidence_source", **{"answer.evidence": [{"source": "x", "lines": [9]}]}),
        one("evidence_lines_not_list", **{"answer.evidence": [{"source": "guideline", "lines": 1}]}), one("evidence_lines_empty", **{"answer.evidence": [{"source": "guideline", "lines": []}, {"source": "general_knowledge", "lines": [99]}]}),
        one("evidence_line_not_int,evidence_line_not_int", **{"answer.evidence": [{"source": "guideline", "lines": ["1", True, 2]}]}), one("evidence_line_not_positive,evidence_line_out_of_guideline_range", **{"answer.evidence": [{"source": "guideline", "lines": [0, 11]}]}),
        one("evidence_path_missing", **{"answer.evidence_path": " "}), one("meta_sample_id_mismatch", **{"meta.sample_id": "x"}), one("meta_family_mismatch", **{"meta.family": "x"}), one("origin_guideline_evidence_path_mismatch", **{"meta.origin_guideline": "h.txt"}),
        one("invalid_batch_index", **{"meta.batch_index": 0}), one("invalid_batch_index", **{"meta.batch_index": True}), one("missing_batch_index", **{"meta.batch_index": _GONE}),
    ]


CASES = _cases()
_SQL_CODES = "[" + ", ".join(f"'{codes}'" for _, codes in CASES) + "]"


def _lines(spark, folder):
    lines = F.array(*[F.lit(line) for line, _ in CASES])
    p = table(spark, folder, "part").select("p_partkey", F.get(lines, F.pmod("p_partkey", F.lit(len(CASES))).cast("int")).alias("line"))
    return L.parsed(p)


@query("rule_lint_rows", f"SELECT p_partkey, {_SQL_CODES}[p_partkey % {len(CASES)} + 1] AS codes FROM part")
def rule_lint_rows(spark, folder):
    return _lines(spark, folder).select("p_partkey", F.array_join(L.row_codes(F.lit(10)), ",").alias("codes"))


@query("rule_lint_counts", f"SELECT code, count(*) AS n FROM (SELECT unnest(string_split({_SQL_CODES}[p_partkey % {len(CASES)} + 1], ',')) AS code FROM part) WHERE code <> '' GROUP BY code")
def rule_lint_counts(spark, folder):
    return _lines(spark, folder).select(F.explode(L.row_codes(F.lit(10))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


_GROUPED = """WITH r AS (SELECT event_id // 3 AS g, event_id % 3 + 1 AS v, (event_id // 3) % 9 AS d FROM events), c AS (SELECT g, any_value(d) AS d, count(*) AS rows, max(v) AS last, min(v) AS first FROM r GROUP BY g),
k AS (SELECT g, rows, list_filter([CASE WHEN rows <> 3 THEN 'groups_not_3_rows' END, CASE WHEN rows <> 3 OR (d = 7 AND rows > 1) THEN 'groups_not_3_variants' END, CASE WHEN d = 1 AND last = 3 AND rows > 1 THEN 'groups_scope_conflict' END, CASE WHEN d = 2 AND last = 3 AND rows > 1 THEN 'groups_label_conflict' END,
 CASE WHEN d = 3 AND last = 3 AND rows > 1 THEN 'groups_answer_type_conflict' END, CASE WHEN d IN (3, 4) AND last = 3 AND rows > 1 THEN 'groups_correct_answer_conflict' END, CASE WHEN d = 5 AND last = 3 AND rows > 1 THEN 'groups_answer_options_conflict' END, CASE WHEN rows <> 3 OR d IN (6, 7) THEN 'groups_variant_suffix_not_exact_v1_v2_v3' END], lambda x: x IS NOT NULL) AS c FROM c)
SELECT 'GEN_' || g AS group_id, rows, array_to_string(c, ',') AS codes FROM k"""


def _groups(spark, folder):
    """Groups of three events; in eight of nine the third row, or its variant, differs in one way."""
    e = table(spark, folder, "events").select("event_id", F.floor(F.col("event_id") / 3).cast("long").alias("g"), (F.col("event_id") % 3 + 1).alias("v")).withColumn("d", F.when(F.col("v") == 3, F.col("g") % 9).otherwise(0))
    name = F.concat(F.lit("GEN_"), F.col("g").cast("string"))
    if_ = lambda d, odd, even: F.when(F.col("d") == d, odd).otherwise(even)
    number = F.when(F.col("d") == 6, 4).when(F.col("d") == 7, 1).otherwise(F.col("v"))
    options = if_(5, F.array(F.lit("No"), F.lit("Yes")), F.array(F.lit("Yes"), F.lit("No")))
    answer = F.struct(if_(1, "class", "general").alias("scope"), if_(2, "nv", "").alias("label"), if_(3, "short_list", "boolean").alias("answer_type"), if_(4, "no", F.when(F.col("d") == 3, "true").otherwise("yes")).alias("correct_answer"), options.alias("answer_options"), name.alias("group_id"), F.concat(name, F.lit("_v"), number.cast("string")).alias("variant_id"))
    return L.parsed(e.select("event_id", F.to_json(F.struct(F.when(F.col("d") == 8, "same").otherwise(F.col("event_id").cast("string")).alias("prompt"), answer.alias("answer"))).alias("line")))


@query("rule_lint_groups", _GROUPED)
def rule_lint_groups(spark, folder):
    return L.group_codes(_groups(spark, folder)).withColumn("codes", F.array_join("codes", ","))


@query("rule_lint_repeats", """WITH r AS (SELECT event_id // 3 AS g, event_id % 3 + 1 AS v FROM events), x AS (SELECT g, count(*) FILTER (v = 1) AS a, count(*) FILTER (v = 3) AS b FROM r GROUP BY g)
SELECT 'duplicate_prompt_count' AS code, CAST(CASE WHEN count(*) FILTER (b > 0 AND g % 9 = 8) > 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM x UNION ALL SELECT 'duplicate_variant_id_count', count(*) FILTER (a > 0 AND b > 0 AND g % 9 = 7) FROM x""")
def rule_lint_repeats(spark, folder):
    return L.repeats(_groups(spark, folder))
