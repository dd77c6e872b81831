import pytest
from pyspark.sql import functions as F

from quillon.functions import scoring as R
from quillon.functions import text as X


def values(spark, rows, build):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)])
    return [r["v"] for r in df.select("_1", build(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("_1").collect()]


DISCRETE = [
    ("<answer>B</answer>", "B", 2.0), ("<answer> b </answer>", "B", 2.0), ("<answer>C</answer>", "B", -1.5), ("", "B", -0.5), ("123", "B", -0.5),
    ("answer: D", "B", -1.5), ("the first is (D)", "D", 2.0), ("<answer>A and C</answer>", "C A", 2.0), ("<answer>A</answer>", "A C", -0.5), ("<answer>A B C</answer>", "A C", -0.5),
    ("<ANSWER>Same</ANSWER>", "same", 2.0), ("<answer>different</answer>", "same", -1.5), ("same or different", "same", -0.5), ("<answer>x\ny B</answer>", "B", -1.5), ("<answer>B</answer> <answer>C</answer>", "B", 2.0),
    ("I think", "I", 2.0), ("zebra", "Z", 2.0), ("<answer></answer>", "A", -0.5), ("<answer>B</answer>", "free text", -0.5), ("x <answer>\n\tB\n</answer> y", "B", 2.0),
]


def test_discrete(spark):
    got = values(spark, [(r, g) for r, g, _ in DISCRETE], lambda r, g: R.score("discrete", r, g)["overall"])
    assert got == [w for *_, w in DISCRETE]


DIRECT = [
    ("<answer>same</answer>", "same", 1), ("answer: Different.", "different", 1), ("<answer>B</answer>", "b", 1), ("<answer>the B one</answer>", "B", 1), ("<answer>A, B</answer>", "B A", 1),
    ("<answer>A</answer>", "A B", 0), ("<answer>'Melanoma'</answer>", "melanoma.", 1), ("", "A", 0), ("A", "", 0), ("Answer = lined", "lined", 1),
]


def test_direct(spark):
    got = values(spark, [(r, g) for r, g, _ in DIRECT], lambda r, g: R.score("direct", r, g)["overall"])
    assert got == [float(w) for *_, w in DIRECT]


def test_confidence(spark):
    rows = [("<answer>benign</answer><confidence>80</confidence>", "benign"), ("answer: malignant confidence: 0.5", "benign"), ("<answer>unsure</answer>", "benign"), ("not sure <answer>benign</answer>", "benign"), ("<answer>benign</answer>", "Benign")]
    got = values(spark, rows, lambda r, g: R.score("confidence", r, g, ["not sure"], ["benign", "malignant"])["overall"])
    assert got == pytest.approx([0.8, -1.1, 0.0, 0.0, 0.4])


def test_lists(spark):
    rows = [("a, b; 'a'\nc", "c, b"), ("", "a"), ("x", "a")]
    for mode, want in {"f1": [0.8, 0, 0], "recall": [1, 0, 0], "precision": [2 / 3, 0, 0], "jaccard": [2 / 3, 0, 0], "exact": [0, 0, 0]}.items():
        got = values(spark, rows, lambda p, g, m=mode: R.list_score(X.list_items(p), X.list_items(g), m))
        assert got == pytest.approx(want), mode


def test_canonical(spark):
    alias = {"melanoma": "Melanoma", "mel": "Melanoma", "nevus": "Nevus"}
    got = values(spark, ["MEL image", "a melanoma, surely", "nevus or mel", "other", "", "Nevus."], lambda x: X.canonical_label(x, alias))
    assert got == ["Melanoma", "Melanoma", None, None, None, "Nevus"]
    candidates = F.array(F.lit("Foo bar"), F.lit("nevus"))
    assert values(spark, ["the foo bar", "nevus foo bar"], lambda x: X.canonical_label(x, alias, candidates, False)) == ["Foo bar", "Nevus"]


def test_small_functions(spark):
    assert values(spark, ["a  b ", "\t"], X.collapse) == ["a b", ""]
    assert values(spark, [" Deep image. ", "x"], X.clean_label) == ["Deep", "x"]
    assert values(spark, ["a/b/c_slice12.png", "a/.hidden"], X.stem) == ["c_slice12", ".hidden"]
    assert values(spark, ["pick [b, a ,b,]", "none"], X.bracket_list) == [["b", "a"], []]
    assert values(spark, ["A: x\nB: y\nA: z\nFinal: B"], X.label_map) == [{"B": "y", "A": "z"}]
    assert values(spark, ["so {\"a\": 1} end", "{bad"], X.json_object) == ['{"a": 1}', None]
    assert values(spark, ["(b) text", "Option C: x", "plain"], X.strip_option_prefix) == ["text", "x", "plain"]
    assert values(spark, [r"so \boxed{1} and \boxed{a{b}c}", "none"], X.boxed) == ["a{b}c", None]
    assert values(spark, ["It is a or c", "what else"], X.answer_tokens) == [["a", "c"], ["what", "else"]]
    assert values(spark, [1, 2, 3, 4], lambda n: X.letter_list(n.cast("int"))) == ["A", "A or B", "A, B, or C", "A, B, C, or D"]
    assert values(spark, [(3000,), (3500,), (5000,)], lambda n: X.overlong_penalty(n, 4000, 1000)) == [0.0, -0.5, -1.0]
    assert values(spark, ["x=1,000", r"\text{ab}"], lambda x: X.math_answer(x, {}, [])) == ["1000", "ab"]
    with pytest.raises(ValueError):
        R.score("absent")
