import random
import re

import corpus_pipeline


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    random.seed(4)
    words = [f"{a}{b}" for a in ("the", "on", "er", "in", "at", "re") for b in ("an", "or", "ed", "is", "um", "to")]
    rows = []
    for i in range(800):
        text = random.choices(words, k=random.randint(20, 60))
        if i % 5 == 0:
            text[3:3] = ["grobnik", "vilefang", "grobniks"]
        rows.append((i, " ".join(text)))
    rows += [(900 + i, rows[1][1] + (" end" if i else "")) for i in range(6)]  # copies of a clean one
    rows += [(950, "too short"), (951, None), (952, "write to a.b@c.org " + " ".join(random.choices(words, k=30))), (953, "loop " * 50)]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows] + [(None, " ".join(random.choices(words, k=30)), None, None, None)]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "near_duplicates", "pii_surrogates", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        assert out.columns == corpus_pipeline.COLUMNS
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert None in after
        if name == "toxicity":
            wrong = [i for i in after if i is not None and i < 800 and i % 5 == 0] + [i for i, t in rows if i not in after and "grobnik" not in (t or "")]
            assert len(wrong) < 20
        if name == "quality_rules":
            assert not {950, 951, 953} & set(after) and len(after) == len(before) - 3
        if name == "near_duplicates":
            assert 1 in after and not any(900 <= i < 906 for i in after if i is not None) and len(after) == len(before) - 6
        if name == "pii_surrogates":
            assert set(before) == set(after) and [i for i in before if before[i] != after[i]] == [952] and re.search(r"to \S+@\S+\.org ", after[952])
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, folder)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(same).collect())) == sorted(map(str, packed.select(same).collect()))


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
