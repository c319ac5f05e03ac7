import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics, search, selection
from quillon.operators.indexing import KeywordIndex, file_heads, manifest_diff, run_report, stale_ids, write_ahead


def ranking(spark, *ids, q=1):
    return spark.createDataFrame([(q, i, n) for n, i in enumerate(ids, 1)], "query_id int, id string, rank int")


def order(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    assert order(search.fuse([ranking(spark, "x", "y"), ranking(spark, "y", "z")])) == ["y", "x", "z"]
    assert order(search.fuse([ranking(spark, "b"), ranking(spark, "a")])) == ["a", "b"]
    twice = {r["id"]: r["score"] for r in search.fuse([ranking(spark, "a", "a", "b")]).collect()}
    assert twice == {"a": round(1 / 61, 9), "b": round(1 / 62, 9)}
    weighted = {r["id"]: r["score"] for r in search.fuse([ranking(spark, "a"), ranking(spark, "b")], [3, 1]).collect()}
    assert weighted == {"a": round(3 / 61, 9), "b": round(1 / 61, 9)}
    for bad in (dict(weights=[1]), dict(k=0)):
        with pytest.raises(ValueError):
            search.fuse([ranking(spark, "a"), ranking(spark, "b")], **bad)


def test_bm25_is_the_formula(spark):
    docs = [("a", "app/user.py", "login", "def login(user): return user"), ("b", "app/cart.py", None, "cart total"), ("c", "x.md", None, "user user guide")]
    chunks = spark.createDataFrame(docs, "id string, path string, symbol string, text string")
    index = KeywordIndex.build(chunks)
    q = spark.createDataFrame([(1, "where is the user login?"), (2, "the"), (3, None)], "query_id int, question string")
    got = {r["id"]: r["score"] for r in search.bm25(index, q, 5).collect()}
    # tokens: a = app user py login | def login user return user; b = app cart py | cart total; c = md | user user guide
    length = {"a": 9, "b": 5, "c": 4}
    tf = {"user": {"a": (1, 2), "c": (0, 2)}, "login": {"a": (1, 1)}}
    want = {}
    for hits in tf.values():
        idf = math.log((3 - len(hits) + 0.5) / (len(hits) + 0.5))
        idf = idf if idf > 0 else 1e-6
        for d, (m, b) in hits.items():
            f = 4 * m + b
            want[d] = want.get(d, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / 6))
    assert got == {k: round(v, 6) for k, v in want.items()}
    assert search.bm25(index, q, 0).count() == 0


def test_cosine_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[5] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    u = v.astype(np.float32).astype(float)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
    got = {}
    for r in search.cosine(df, q, 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in range(0, 300, 50):
        s = np.round(u @ u[i], 6)
        assert [got[i][k] for k in range(1, 8)] == sorted(range(300), key=lambda j: (-s[j], j))[:7]
    few = search.cosine(df, q, 7, only=df.where("vec_id < 10").select("vec_id"))
    assert few.agg(F.max("id")).first()[0] < 10
    assert search.cosine(df, q.limit(0), 3).count() == 0
    old, search.QUERY_CELLS = search.QUERY_CELLS, 16  # several passes give the same
    try:
        assert sorted(map(tuple, search.cosine(df, q, 7).collect())) == sorted((a, b[k], r, k) for a, b in got.items() for k in b for r in [round(float(u[b[k]] @ u[a]), 6)])
    finally:
        search.QUERY_CELLS = old


def test_penalties_keep_order_of_ties_and_spare_questions_about_tests(spark):
    rows = [(1, "how does it work", "a", "tests/x.py", 1.0, 1), (1, "how does it work", "b", "src/x.py", 0.6, 2), (1, "how does it work", "c", "src/y.py", 0.6, 3), (2, "where are the tests", "a", "tests/x.py", 1.0, 1), (2, "where are the tests", "b", "src/x.py", 0.9, 2), (3, "q", "n", "tests/n.py", -1.0, 1), (3, "q", "m", "m.py", -1.2, 2)]
    df = spark.createDataFrame(rows, "query_id int, question string, id string, path string, score double, rank int")
    out = search.penalise_paths(df)
    assert order(out.where("query_id = 1")) == ["b", "c", "a"] and order(out.where("query_id = 2")) == ["a", "b"] and order(out.where("query_id = 3")) == ["m", "n"]
    assert order(search.penalise_paths(df, 1.0).where("query_id = 1")) == ["a", "b", "c"]


def test_rerank_head_and_tail(spark):
    df = ranking(spark, "a", "b", "c", "d").withColumn("score", 10.0 - F.col("rank")).withColumn("new", F.when(F.col("id") == "b", 5.0).otherwise(1.0))
    out = search.rerank(df, F.col("new"), head=2)
    assert order(out) == ["b", "a", "c", "d"]
    scores = {r["id"]: r["score"] for r in out.collect()}
    assert scores["c"] == round(1.0 - 1e-6, 9) and scores["d"] == round(1.0 - 2e-6, 9)
    one = search.rerank(ranking(spark, "a").withColumns({"score": F.lit(3.0), "new": F.lit(9.0)}), F.col("new"))
    assert one.first()["score"] == 3.0


def chosen(spark, rows, **kw):
    df = spark.createDataFrame([(1, f"{p}{n}", p, n, t) for n, (p, t) in enumerate(rows, 1)], "query_id int, id string, path string, rank int, tokens long")
    return [r["rank"] for r in selection.select_chunks(df, **kw).orderBy("position").collect()]


def test_selection(spark):
    assert chosen(spark, [("a", 100), ("a", 100), ("a", 100), ("b", 100)], budget=300) == [1, 4, 2]
    assert chosen(spark, [("a", 500), ("b", 100)], budget=300) == [1]
    assert len(chosen(spark, [(c, 400) for c in "abcdefgh"], budget=1000)) == 2
    assert chosen(spark, [("a", 100), ("b", 900), ("c", 50)], budget=200) == [1, 3]
    assert chosen(spark, [("a", 1)] * 5, per_file=2) == [1, 2]
    assert len(chosen(spark, [(c, 1) for c in "abcdefgh"], max_chunks=5)) == 5


def merged(spark, *spans, context=()):
    rows = [(1, "f.py", f"c{n}", s, e, f"s{n}", "function", 1.0 / n, n, n in context) for n, (s, e) in enumerate(spans, 1)]
    df = spark.createDataFrame(rows, "query_id int, path string, id string, start_line int, end_line int, symbol string, kind string, score double, rank int, context boolean")
    return df, selection.merge_spans(df)


def test_merging(spark):
    spans = lambda *s, **k: sorted((r["start_line"], r["end_line"], r["role"]) for r in merged(spark, *s, **k)[1].collect())
    assert spans((1, 10), (6, 15)) == [(1, 15, "match")]
    assert spans((1, 5), (6, 9)) == [(1, 9, "match")]
    assert spans((1, 5), (7, 9)) == [(1, 5, "match"), (7, 9, "match")]
    assert spans((1, 2), (9, 9), context=(1,)) == [(1, 2, "context"), (9, 9, "match")]
    assert spans((1, 2), (3, 9), context=(1,)) == [(1, 9, "match")]
    assert spans((1, 20), (2, 3), (15, 25)) == [(1, 25, "match")]
    df, out = merged(spark, (1, 3), (2, 4))
    texts = spark.createDataFrame([("c1", "a\nb\nc"), ("c2", "B\nC\nD")], "id string, text string")
    assert selection.merged_text(df.join(texts, "id"), out).first()["text"] == "a\nB\nC\nD"


def test_class_headers(spark):
    chunks = spark.createDataFrame([("h", "a.py", "class", "A", 1, 3, "class A:"), ("h2", "a.py", "class", "A", 9, 9, "class A:"), ("m", "a.py", "method", "A.f", 4, 6, "x")], "id string, path string, kind string, symbol string, start_line int, end_line int, text string")
    pick = spark.createDataFrame([(1, "m", "a.py", "method", "A.f", 2, 5, 1), (1, "n", "a.py", "method", "A.g", 3, 5, 2)], "query_id int, id string, path string, kind string, symbol string, rank int, tokens long, position int")
    assert [tuple(r) for r in selection.add_class_headers(pick, chunks).collect()] == [(1, "h", 2, 2)]
    assert selection.add_class_headers(pick, chunks, budget=11).count() == 0


def test_budget_prefix_stops_at_the_first_overrun(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, 100), (1, "b", 1, 2, 300), (1, "c", 1, 3, 10), (2, "a", 1, 1, 900)], "query_id int, path string, start_line int, rank int, tokens long")
    assert sorted((r["query_id"], r["path"]) for r in selection.within_budget(df, 200).collect()) == [(1, "a"), (2, "a")]


def test_manifest(spark):
    schema = "path string, file_hash string, chunk_ids array<string>"
    old = spark.createDataFrame([("a", "1", ["x", "y"]), ("b", "1", ["z"]), ("c", "1", [])], schema)
    new = spark.createDataFrame([("a", "2", ["y", "w"]), ("c", "1", []), ("d", "1", ["v"])], schema)
    diff = manifest_diff(old, new)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"a": "changed", "b": "removed", "c": "unchanged", "d": "new"}
    assert run_report(diff).first().asDict() == {"files": 4, "new": 1, "changed": 1, "unchanged": 1, "removed": 1}
    assert sorted(map(tuple, stale_ids(old, new).collect())) == [("a", "x"), ("b", "z")]
    assert {r["path"]: r["chunk_ids"] for r in write_ahead(old, new).collect()}["a"] == ["w", "x", "y"]


def test_file_heads(spark):
    df = spark.createDataFrame([("r", "a", 1, 9, "long", "i1"), ("r", "a", 1, 3, "short", "i2"), ("r", "b", 2, 3, "no", "i3")], "repo_id string, path string, start_line int, end_line int, text string, id string")
    assert [tuple(r) for r in file_heads(df).collect()] == [("r", "a", "short")]


def test_ranking_measures(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4), ("b", None)], "type string, rank int")
    total = {r["type"]: r for r in metrics.ranking_report(df).collect()}["(all)"]
    assert (total["hit_1"], total["hit_3"], total["hit_5"], total["hit_10"], total["mrr"]) == (0.25, 0.5, 0.75, 0.75, round((1 + 0.5 + 0.25) / 4, 6))
    assert metrics.misses(df, 3).count() == 2
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, path string, rank int")
    gold = spark.createDataFrame([(1, "y"), (1, "z"), (2, "x")], "query_id int, path string")
    assert sorted(map(tuple, metrics.gold_ranks(q, ranked, gold).collect())) == [(1, 2), (2, None)]


def test_area_coverage_and_agreement(spark):
    wanted = spark.createDataFrame([(1, "/src/a/"), (1, "lib"), (2, "x")], "query_id int, directory string")
    shown = spark.createDataFrame([(1, "src/a/b/c.py"), (2, "xy/z.py")], "query_id int, path string")
    assert {r["query_id"]: r["coverage"] for r in metrics.area_coverage(wanted, shown).collect()} == {1: 0.5, 2: 0.0}
    pairs = spark.createDataFrame([("supported", "supported"), ("supported", "partially_supported"), ("supported", "unsupported"), ("supported", "odd")], "a string, b string")
    assert tuple(metrics.ordinal_agreement(pairs, "a", "b").first()) == (3, 1, 2)
