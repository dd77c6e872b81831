import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import topk, warc

PAGE = "page_id long, url string, html string, digest string"


def test_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/1", big, "x"), (5, "http://a/ 5\r\n", big, "x"), (9, None, big, "x"), (2, "u", "small", "x"), (3, "u", "small", "x"), (4, "u", None, "x"), (6, "u", "", "x"), (7, "u", other, "x"), (7, "u", other, "x"), (8, "u", "a" * 999, "x"), (10, "u", "a" * 999, "x")]
    out = sorted(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, PAGE)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = []
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        last = max(j for j, _, h, _ in rows if (h or "") == (html or ""))
        revisit = len(payload) >= 1000 and i < last
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert out == sorted(want)
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0
    none = warc.round_trip(spark.createDataFrame([(None, "u", big, "x"), (3, "u", big, "x"), (4, "u", "y" * 400_000, "x")], PAGE)).collect()
    assert {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in none} == {(None, 1200, "response", None), (3, 1200, "response", None), (4, 400_000, "response", None)}


def test_archive_is_standard_gzip_and_is_verified():
    raw = b"".join(warc.record("response", i, "http://x", b"<p>" * (10**i)) for i in range(5))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 5
    found = list(warc.records(io.BytesIO(raw)))
    assert [len(r.http()[1]) for r in found] == [3 * 10**i for i in range(5)]
    assert warc.page_of(found[3].headers["warc-record-id"]) == 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[:-20])))
    broken = gzip.compress(gzip.decompress(warc.record("response", 1, "u", b"abc")).replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken)))
    short = gzip.compress(gzip.decompress(warc.record("response", 1, "u", b"abc"))[:-4])
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(short)))


def brute(rows, k):
    out = []
    clean = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in clean:
        if i % 20 == 0:
            scores = sorted(((-int(q @ x), j) for j, x in clean if j != i))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "clustered", "equal", "large"])
def test_top_k_is_exact(spark, shape, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    draw = np.random.default_rng(4)
    n, d = 900, 6
    centres = draw.normal(size=(5, d)) * 3
    vectors = {"random": draw.normal(size=(n, d)), "clustered": centres[draw.integers(0, 5, n)] + 0.05 * draw.normal(size=(n, d)), "equal": np.tile(centres[:3], (n // 3, 1)), "large": np.floor(draw.normal(size=(n, d)) * 30) * 2.0**14}[shape]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(10000, None), (10020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (10040, [float("nan")] * d), (None, [1.0] * d), (10060, [float("inf")] * d)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, pivot int, rank int")
    got = topk.top_k(topk.quantised(df), 20, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20)


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [3.0])]
    got = topk.top_k(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 2, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(0, 7, 8192), (0, 7, 12288), (0, 7, 12288), (0, 8, 24576)]


def test_trees_come_back_from_pages():
    draw = np.random.default_rng(5)
    x = np.floor(draw.normal(size=(5000, 7)) * 64)
    tree = topk.MTree(x, draw.permutation(5000))
    again = topk.MTree.of_pages(list(tree.pages())[::-1], 7)
    a, b = (t.search(x[:50], 9, np.arange(50), np.full(50, -np.inf), wide) for t, wide in ((tree, False), (again, True)))
    assert sorted(zip(*a, strict=True)) == sorted(zip(*b, strict=True))


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.quantised(df), 20, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, -4096)]
    assert topk.top_k(topk.quantised(df.where("false")), 20, F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_save_products():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 8)) * 50
    x = np.floor(centres[draw.integers(0, 40, 8000)] + draw.normal(size=(8000, 8)))
    tree = topk.MTree(x, np.arange(8000))
    tree.computed = 0
    tree.search(x[:1], 20, np.array([0]), np.array([-np.inf]))
    assert tree.computed < 4000
