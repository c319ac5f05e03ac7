"""Keyword search by document: the same ranking as by postings, without moving pairs of questions and documents."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.functions.embedding import HashEmbedder, embed
from quillon.functions.identifiers import ascii_tokens, identifier_tokens, text_tokens, tokens_of
from quillon.operators import indexing, search, selection
from quillon.operators.indexing import AskedIndex, KeywordIndex, terms_of

DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata/sf0.001")
WORDS = ["get_user", "getUserById", "load", "page", "Page2", "straße", "x", "HTTPServer", "the", "index", "_", "école", "rare_one"]


def corpus(spark, n=120, seed=3):
    r = random.Random(seed)
    rows = [(f"id{i:03d}", f"src/{r.choice(WORDS)}.py", r.choice([None, "load"]), " ".join(r.choice(WORDS[: 12 + (i == 7)]) for _ in range(r.randint(0, 30)))) for i in range(n)]
    rows += [("twin", *rows[4][1:]), ("empty", None, None, None)]
    asked = [(1, "where is get_user loaded?"), (2, "the page of getUserById"), (3, "rare_one or index"), (4, "nothing_here"), (5, None), (6, "école straße HTTPServer page load index user")]
    return spark.createDataFrame(rows, "id string, path string, symbol string, text string"), spark.createDataFrame(asked, "query_id int, question string"), rows


def brute(rows, asked, k):
    docs = {}
    for i, path, symbol, text in rows:
        split = lambda t: [x for w in re.findall(r"\w+", t) for x in tokens_of(w)]
        docs[i] = split(" ".join(x for x in (path, symbol) if x)), split(text or "")
    docs = {i: x for i, x in docs.items() if x[0] or x[1]}
    mean = sum(len(m) + len(b) for m, b in docs.values()) / len(docs)
    out = set()
    for q, terms in asked.items():
        score = {}
        for t in terms:
            df = sum(t in m or t in b for m, b in docs.values())
            odds = math.log((len(docs) - df + 0.5) / (df + 0.5))
            for i, (m, b) in docs.items():
                if f := 4 * m.count(t) + b.count(t):
                    score[i] = score.get(i, 0) + (odds if odds > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(m) + len(b)) / mean))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
        out |= {(q, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("k,block,sent", [(3, 1 << 20, 1 << 19), (3, 40, 1 << 19), (50, 200, 4), (500, 1, 1 << 19)])
def test_search_by_document_equals_brute_force(spark, monkeypatch, k, block, sent):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "SENT_TERMS", sent)
    chunks, asked, rows = corpus(spark)
    terms = {}
    for r in terms_of(asked).collect():
        terms.setdefault(r["query_id"], []).append(r["term"])
    want = brute(rows, terms, k)
    twice = chunks.union(chunks.where("id < 'id050'"))
    for index in (AskedIndex.build(twice, asked), KeywordIndex.build(chunks)):
        assert {tuple(r) for r in search.bm25(index, asked, k).collect()} == want


def test_asked_index_has_the_postings_of_the_whole_one(spark):
    chunks, asked, _ = corpus(spark)
    part, whole = AskedIndex.build(chunks, asked), KeywordIndex.build(chunks)
    terms = terms_of(asked).select("term").distinct()
    for name, columns in (("postings", ["term", "id", "tf_meta", "tf_body"]), ("frequencies", ["term", "df"])):
        assert sorted(map(tuple, getattr(part, name).select(columns).collect())) == sorted(map(tuple, getattr(whole, name).join(terms, "term", "left_semi").select(columns).collect()))
    assert sorted(map(tuple, part.documents.select("id", "length").collect())) == sorted(map(tuple, whole.lengths.collect()))
    with pytest.raises(ValueError):
        search.bm25(part, spark.createDataFrame([(1, "another")], "query_id int, question string"))


def test_tokens_of_a_word_in_python(value):
    for w in [*WORDS, "ABCdef12_3", "İstanbul", "ΑΣ", "a1", "__init__", "數據"]:
        assert tokens_of(w) == value(identifier_tokens, w=w)


def test_pairs_of_questions_and_documents_are_not_shuffled(spark):
    chunks, asked, _ = corpus(spark)
    for index in (AskedIndex.build(chunks, asked), KeywordIndex.build(chunks)):
        plan = search.bm25(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_tokens_of_ascii_words_in_bytes():
    for w in [*WORDS, "ABCdef12_3", "a1", "__init__", "A", "_", "_foo", "HTTP2Server", "x_y", "9", "42"]:
        if w.isascii():
            assert [t.decode() for t in ascii_tokens(w.encode())] == tokens_of(w)


def test_first_block_of_documents_is_smaller(monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 1 << 15)
    n, lists = 20_000, pa.array([[0, 1, 2, 3]] * 20_000, pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array(range(n)), pa.array([9] * n), lists, lists, lists], ["id", "length", "terms", "tf_meta", "tf_body"])
    sizes = [len(block[0]) for block in search._blocks(iter([batch]))]
    assert sum(sizes) == n and sizes[0] * 4 <= sizes[1]


def kept(monkeypatch, name, spark):
    """What a query stores on its way, and its result."""
    from quillon.plans import queries

    frames, plain = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df: frames.append(df) or plain(df))
    result = queries.queries()[name](spark, DATA)
    return [*frames, result]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sources_move_the_texts_of_chosen_chunks_only(spark, monkeypatch):
    ranked, picked, spans, _ = kept(monkeypatch, "retrieved_sources", spark)
    assert "text" not in ranked.columns and "first(text" not in plan(ranked) and "text" not in picked.columns
    assert spans.count() == picked.count() and spans.where("text is null").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["ablation_grid", "ablation_pairs", "hybrid_sources", "context_prefix", "prompts"])
def test_searching_needs_no_index_of_all_words(spark, monkeypatch, name):
    from quillon.plans import queries

    def refuse(*a, **k):
        raise AssertionError("all words of all chunks were indexed")

    monkeypatch.setattr(KeywordIndex, "build", refuse)
    monkeypatch.setattr(queries, "_INDEXES", {})
    assert queries.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("cells,tile,exact,k", [(64, 2, 3, 5), (1 << 20, 256, 1 << 13, 40), (8, 256, 1, 1)])
def test_cosine_in_single_precision_is_exact_with_ties_and_near_ties(spark, monkeypatch, cells, tile, exact, k):
    for name, value in (("VECTOR_CELLS", cells), ("QUERY_TILE", tile), ("EXACT_PAIRS", exact)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8))
    v[20:50] = v[10] + rng.normal(size=(30, 8)) * 2e-4  # differ by less than single precision tells
    v[50:60], v[60:64] = v[3], 0
    ids = [f"d{i:02d}" for i in rng.permutation(90)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, embedding array<double>").repartition(3)
    asked = [10, 3, 60, 0, 7]
    q = spark.createDataFrame([(i, v[i].tolist()) for i in asked], "query_id int, embedding array<double>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    want = {(a, i, -s, n) for a in asked for n, (s, i) in enumerate(sorted(zip((-np.round(u @ u[a], 6)).tolist(), ids))[:k], 1)}
    assert {tuple(r) for r in search.cosine(df, q, k, id_col="id").collect()} == {(a, i, s + 0.0, n) for a, i, s, n in want}


def test_texts_become_vectors_in_the_task_that_searches_them(spark):
    chunks, asked, _ = corpus(spark)
    embedder = HashEmbedder(64)
    asked = embed(asked, embedder, ["query_id"], "question")
    want = search.cosine(embed(chunks, embedder, ["id"], "text"), asked, 9, id_col="id")
    got = search.cosine(chunks, asked, 9, id_col="id", text_col="text", embedder=embedder)
    assert (plan(got).count("MapInArrow"), plan(want).count("MapInArrow")) == (1, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tokens_of_many_texts_at_once_are_those_of_their_words():
    r, asked = random.Random(7), [b"a", b"ab", b"ba", b"bb", b"19", b"__", b"_", b"zz", b"aab", b"get_user"]
    for _ in range(200):
        texts = [None if r.random() < 0.1 else "".join(r.choice("aAbB1_ .9zZ" + "é" * (r.random() < 0.05)) for _ in range(r.randint(0, 30))).encode() for _ in range(r.randint(0, 20))]
        lo = r.randint(0, len(texts))
        lengths, rows, places, other = text_tokens(pa.array(texts, pa.binary()).slice(lo), pa.array(asked, pa.binary()))
        plain = [(x or b"") if (x or b"").isascii() else None for x in texts[lo:]]
        want = [[t for w in re.findall(rb"\w+", x or b"") for t in ascii_tokens(w)] for x in plain]
        assert lengths.tolist() == [len(x) for x in want] and other.tolist() == [n for n, x in enumerate(plain) if x is None]
        assert sorted(zip(rows.tolist(), places.tolist())) == sorted((n, asked.index(t)) for n, x in enumerate(want) for t in x if t in asked)


def test_pieces_of_batches_have_a_bound_and_all_rows(monkeypatch):
    monkeypatch.setattr(indexing, "COUNTED_BYTES", 10)
    batch = pa.record_batch([pa.array(range(6)), pa.array([b"x" * 4, None, b"x" * 5, b"x" * 50, b"", b"x"])], ["id", "text"])
    pieces = [p.column("id").to_pylist() for p in indexing._pieces(iter([batch, batch.slice(0, 0)]))]
    assert pieces == [[0, 1, 2], [3, 4], [5]]


@pytest.mark.parametrize("wide", [1, 8, 1000])
def test_terms_of_many_documents_are_added_up_once_and_scores_stay(spark, monkeypatch, wide):
    monkeypatch.setattr(search, "WIDE", wide)
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    chunks, asked, rows = corpus(spark)
    terms = {}
    for r in terms_of(asked).collect():
        terms.setdefault(r["query_id"], []).append(r["term"])
    assert {tuple(r) for r in search.bm25(AskedIndex.build(chunks, asked), asked, 4).collect()} == brute(rows, terms, 4)


def test_only_rows_of_sent_ids_are_moved(spark, monkeypatch):
    rows, ids = spark.range(1000), spark.createDataFrame([(3,), (3,), (999,), (5000,)], "id long")
    assert sorted(r["id"] for r in search.of_ids(rows, ids).collect()) == [3, 999]
    monkeypatch.setattr(search, "SENT_IDS", 3)
    assert search.of_ids(rows, ids).count() == 1000


def test_texts_of_merged_spans_equal_those_by_lines(spark):
    r, rows = random.Random(11), []
    for q in range(40):
        for n in range(r.randint(1, 5)):
            start, size = r.randint(1, 12), r.randint(1, 5)
            text = r.choice([None, "", *["\n".join(f"{q}.{n}.{i}" for i in range(size + r.randint(-1, 1)))] * 6])
            rows.append((q, r.choice("ab"), f"c{n}", r.choice([start] * 9 + [None]), start + size - 1, "s", "window", 1.0, n, False, r.choice(["py", None]), text))
    spans = spark.createDataFrame(rows, "query_id int, path string, id string, start_line int, end_line int, symbol string, kind string, score double, rank int, context boolean, language string, text string")
    plain = selection.merge_spans(spans)
    want = plain.join(selection.merged_text(spans, plain), ["query_id", "path", "start_line"])
    got = selection.merge_spans(spans, texts=True)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 40
    first = {(q, p, i): language for q, p, i, *_, language, _ in rows}
    assert all(x["language"] == first[x["query_id"], x["path"], x["chunk_ids"][0]] for x in got.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_prompts_move_neither_all_texts_nor_lines(spark, monkeypatch):
    ranked, picked, spans, result = kept(monkeypatch, "prompts", spark)
    for frame in (ranked, spans):
        assert "BroadcastHashJoin [xxhash64(id" in plan(frame)
    assert "posexplode" not in plan(result) and plan(result).count("Exchange hashpartitioning") <= 3
