import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.operators import groupstats as G
from quillon.operators import lookup as J
from quillon.operators import reshape as P
from quillon.operators import validate as V
from quillon.sources import io as S
from quillon.streaming import online as O


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [r["a"] for r in S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").orderBy("a").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n[1]\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        S.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    good, bad = S.read_jsonl_lenient(spark, str(tmp_path / "b.jsonl"), "a int")
    assert [r["a"] for r in good.collect()] == [1] and {r["line"] for r in bad.collect()} == {"not json", "[1]"}


def test_lists_and_concatenated_objects(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert S.read_json_list(spark, str(tmp_path / "l.json"), "a int").count() == 2
    (tmp_path / "c.json").write_text('{\n "a": 1\n}\n{\n "a": 2\n}\n')
    assert [r["a"] for r in S.read_concatenated_json(spark, str(tmp_path / "c.json"), "a int").orderBy("a").collect()] == [1, 2]


def test_discovery_and_tables(spark, tmp_path):
    files = spark.createDataFrame([("/r/open/x.json",), ("/r/closed/x.json",), ("/r/closed/y.json",)], "path string")
    assert {(r["stem"], r["path"]) for r in S.discover(files, "open").collect()} == {("x", "/r/open/x.json"), ("y", "/r/closed/y.json")}
    spark.createDataFrame([(1, "train"), (2, "val")], "a int, split string").write.parquet(str(tmp_path / "t.parquet"))
    assert S.read_table(spark, str(tmp_path / "t.parquet") + "@val").first()["a"] == 2
    assert [r[0] for r in J.unknown_names(["x", "z"], S.discover(files, "open"), "stem").collect()] == ["z"]


def test_log(spark):
    text = "noise\n[prompt] p1\nmore\n[output] o1\n[ground_truth] {'a': None}\n[score] 0.5 x\n\n[prompt] p2\n[output] o2\n[ground_truth] g\n[score] bad\n"
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(S.parse_log(F.col("t"))).alias("r")).select("r.*", S.decode_truth(F.col("r.ground_truth")).alias("d")).collect()
    assert (rows[0]["prompt"], rows[0]["output"], rows[0]["score"], json.loads(rows[0]["d"])) == ("p1\nmore", "o1", 0.5, {"a": None})
    assert rows[1]["score"] != rows[1]["score"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    path = str(tmp_path / "out")
    S.write_jsonl(df, path)
    with pytest.raises((PySparkException, Py4JJavaError)):
        S.write_jsonl(df, path)
    S.write_jsonl(df, path, append=True)
    assert S.read_jsonl(spark, path, "a int, b string").count() == 2
    S.write_split(df, str(tmp_path / "split"), "a")
    assert (tmp_path / "split" / "a=1").is_dir()
    assert S.write_summary(df.agg(F.count("*").alias("n")), str(tmp_path / "sum")) == {"n": 1}
    t = str(tmp_path / "tracker")
    assert S.update_tracker(spark, t, 5, 0.5)["best_step"] == 5
    assert S.update_tracker(spark, t, 10, 0.4) == {"best_step": 5, "best_score": 0.5, "last_step": 10}
    assert S.update_tracker(spark, t, 15, 0.9)["best_step"] == 15
    S.write_metrics(spark, {"a/b": 1}, 3, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first()["metric"] == "a/b"


def test_resume_and_cache(spark):
    old = spark.createDataFrame([("A_000003",), ("A_000010",), ("B_000001",), ("junk",)], "id string")
    state = S.resume_state(old, "id", r"^([A-Z])_(\d+)$")
    new = spark.createDataFrame([("A", 1), ("A", 2), ("C", 1)], "label string, n int")
    assert {r["id"] for r in S.numbered_after(new, "label", "n", state).collect()} == {"A_000011", "A_000012", "C_000001"}
    hit, miss = S.cached_responses(new, spark.createDataFrame([("A", "x")], "label string, answer string"), "label")
    assert (hit.count(), miss.count()) == (2, 1)


def test_group_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 3, 5.0)], "uid int, sid int, score double")
    with pytest.raises((PySparkException, Py4JJavaError)):
        G.grpo(df).collect()
    ok = G.grpo(df.where("uid = 1")).orderBy("sid").collect()
    assert [round(r["advantage"], 4) for r in ok] == [-0.7071, 0.7071]
    best = G.pass_at_k(df.where("uid = 1"), zero_rest=True).orderBy("sid").collect()
    assert [round(r["advantage"], 4) for r in best] == [0.0, 1.4142]
    with pytest.raises(ValueError):
        G.estimate("absent", df)


def test_rewrites(spark):
    df = spark.createDataFrame([("d", "/a/b.png", "what?", "Yes", "yes", "no", None, "none", "qt", "1")], "dataset string, image_path string, question string, gt_answer string, option_A string, option_B string, option_C string, option_D string, question_type string, question_id string")
    row = P.base_rows(df, ["qt"]).first()
    assert row["answer"]["answer_id"] == "A" and row["answer"]["group_id"] == "d::b" and "C." not in row["prompt"]
    assert P.base_rows(df, ["other"]).count() == 0
    m = df.select(P.messages(F.lit(" <image>hi<image> ")).alias("m")).first()["m"]
    assert [(x["type"], x["text"]) for x in m] == [("image", None), ("text", "hi"), ("image", None)]
    p = df.select(P.letter_rewrite(F.lit("Q?\nPlease answer with the option text.")).alias("a"), P.letter_rewrite(F.lit("Q?")).alias("b"), P.resolved(F.array(F.lit("/x"), F.lit("y")), "/r/").alias("c")).first()
    assert p["a"] == p["b"] == "Q?\nAnswer with one letter inside <answer></answer>." and p["c"] == ["/x", "/r/y"]


def test_validation(spark):
    df = spark.createDataFrame([("melanoma?", "it is"), ("size?", "small")], "q string, a string")
    assert [r[0] for r in df.select(V.leaks(F.col("q"), F.col("a"), ["melanoma"], "diagnos")).collect()] == [True, False]
    lines = F.array(F.lit("x" * 45))
    assert df.limit(1).select(V.quotes(F.lit("see " + "x" * 45), lines), V.outside(F.array(F.lit(3), F.lit(9)), 1, 5)).first() == (True, True)
    with pytest.raises((PySparkException, Py4JJavaError)):
        V.require(df, F.col("a") == "small", "no").collect()


def test_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "1.json").write_text('{"question": "a b"}\n{"prompt": "", "problem": "one two three four"}\n{"images": []}\n')
    seen = []

    def act(batch, epoch):
        static = spark.createDataFrame([(1, "s", [], "{}"), (2, "t", [], "{}"), (3, "u", [], "{}")], "id int, prompt string, images array<string>, answer string")
        seen.extend(r["prompt"] for r in O.topped_up(batch, static, "id", 3, 1, epoch).collect())
        O.feedback(out, lambda b: b.select("prompt"))(batch, epoch)

    def once():
        O.each_batch(O.dropped_overlong(O.normalised(O.source(spark, str(inbox))), 3), str(tmp_path / "ck"), act).awaitTermination()

    once()
    assert seen[0] == "a b" and len(seen) == 3 and "one two three four" not in seen
    (inbox / "2.json").write_text('{"prompt": "new"}\n')
    once()
    assert seen[3] == "new" and len(seen) == 6
    assert [r["prompt"] for r in spark.read.parquet(out).collect()] == ["new"]


def test_curves_of_a_stream(spark, tmp_path):
    """Counts by hand over two micro-batches, one of which is run twice."""
    path = str(tmp_path / "steps")
    keep = O.step_counts(path)
    make = lambda rows: spark.createDataFrame(rows, "task string, step long, correct boolean")
    keep(make([("a", 1, True), ("a", 1, False), ("a", 2, True), (None, 1, None)]), 0)
    keep(make([("a", 2, False), ("a", 3, True)]), 1)
    keep(make([("a", 2, False), ("a", 3, True)]), 1)
    got = {(r["task"], r["step"]): r for r in O.task_curves(spark, path, 0.5, 2).collect()}
    assert {k: (r["correct"], r["total"]) for k, r in got.items()} == {("a", 1): (1, 2), ("a", 2): (1, 2), ("a", 3): (1, 1), ("unknown", 1): (0, 1)}
    assert got["a", 3]["rolling_acc"] == pytest.approx(2 / 3)
    assert got["a", 3]["ema"] == pytest.approx((1 / 8 + 1 / 4 + 1 / 2) / (2 / 8 + 2 / 4 + 1 / 2))


def test_mixing_by_probability(spark):
    static = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id int, prompt string")
    batch = spark.createDataFrame([(f"b{i}",) for i in range(30)], "prompt string")
    out = [r["prompt"] for r in O.mixed(batch, static, "id", 0.25, 1, 0).collect()]
    assert sorted(p for p in out if p[0] == "b") == sorted(f"b{i}" for i in range(30)) and len(out) == 40
    assert O.mixed(batch, static, "id", 0.0, 1, 0).count() == 30 == O.mixed(batch, static.where("false"), "id", 0.5, 1, 0).count()
    assert O.mixed(batch.where("false"), static, "id", 0.5, 1, 0).count() == 0
    with pytest.raises(ValueError):
        O.mixed(batch, static, "id", 1.0, 1, 0)


def test_a_table_survives_a_crash_while_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark, spark.range(3), path)
    S.replace_table(spark, spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 2]
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if stopped between the renames
    S.replace_table(spark, spark.range(7, 8), path)
    assert [r[0] for r in spark.read.parquet(path).collect()] == [7]
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.staging").exists()


def test_until_enough(spark):
    make = lambda k: spark.createDataFrame([(10 * k, 1)], "uid int, x int")
    assert O.until_enough(make, lambda d: d, 2, 5).count() == 2
    with pytest.raises(RuntimeError):
        O.until_enough(make, lambda d: d.where("false"), 1, 2)
