import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.functions.claims import claim_rows
from quillon.functions.embedding import HashEmbedder, embed
from quillon.operators.answering import ProviderError, complete
from quillon.operators.chunking import structured_chunks, with_ids
from quillon.operators.indexing import KeywordIndex
from quillon.operators.retrieval import RetrievalError, Retriever
from quillon.operators.search import overlap_score
from quillon.session import stored
from quillon.sources import models, records
from quillon.sources.settings import Settings

FILES = {
    "src/users.py": '"""Users."""\n\n\nclass UserService:\n    """Service of users."""\n\n' + "\n".join(f"    def step_{i}(self, user):\n        return self.db.load(user, {i})\n" for i in range(45)),
    "src/cart.py": "def cart_total(items):\n    return sum(items)\n",
    "tests/test_cart.py": "def test_cart_total():\n    assert cart_total([1]) == 1\n",
    "README.md": "# Shop\n\nA small shop.\n",
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [("r", p, {"py": "python", "md": "markdown"}[p.rsplit(".")[-1]], t, "h") for p, t in FILES.items()]
    files = spark.createDataFrame(rows, "repo_id string, path string, language string, text string, file_hash string")
    chunks = stored(with_ids(structured_chunks(files)))
    embedder = HashEmbedder(64)
    vectors = stored(embed(chunks, embedder, ["id"], "text"))
    questions = spark.createDataFrame([(1, "how is the cart total made"), (2, "what does step_7 of the user service load"), (3, "Give me an overview of this project")], "query_id int, question string")
    asked = stored(questions.join(embed(questions, embedder, ["query_id"], "question"), "query_id"))
    return chunks, KeywordIndex.build(chunks), vectors, asked


@pytest.mark.parametrize("mode", ["keyword", "vector", "hybrid"])
def test_sources_are_lines_of_their_files_and_do_not_overlap(made, mode):
    chunks, keyword, vectors, asked = made
    rows = Retriever(chunks, keyword, vectors, Settings(mode=mode, context_budget=400)).retrieve(asked).collect()
    assert {r["query_id"] for r in rows} >= {1, 2}
    taken = set()
    for r in rows:
        lines = FILES[r["path"]].split("\n")
        assert r["text"] == "\n".join(lines[r["start_line"] - 1 : r["end_line"]])
        span = {(r["query_id"], r["path"], n) for n in range(r["start_line"], r["end_line"] + 1)}
        assert not span & taken
        taken |= span
    if mode == "keyword":
        first = min((r for r in rows if r["query_id"] == 1), key=lambda r: r["rank"])
        assert first["path"] == "src/cart.py"
        assert any(r["role"] == "context" or "UserService" in r["symbols"] for r in rows if r["query_id"] == 2)


def test_filter_rerank_and_checks(made, spark):
    chunks, keyword, vectors, asked = made
    only = spark.createDataFrame([("src/cart.py",)], "path string")
    ranked = Retriever(chunks, None, vectors, Settings(mode="vector")).rank(asked, only)
    assert {r["path"] for r in ranked.collect()} == {"src/cart.py"}
    again = Retriever(chunks, keyword, None, Settings(mode="keyword"), overlap_score(F.col("question"), F.col("text"))).rank(asked.where("query_id = 1"))
    assert again.orderBy("rank").first()["path"] == "src/cart.py"
    for bad in (dict(settings=Settings(mode="vector")), dict(settings=Settings(mode="keyword")), dict(keyword=keyword, settings=Settings(mode="keyword", top_k=0))):
        with pytest.raises(RetrievalError):
            Retriever(chunks, **bad)
    with pytest.raises(RetrievalError):
        Retriever(chunks, keyword, None, Settings(mode="keyword")).rank(asked, only)


def test_overview(made):
    chunks, keyword, _, asked = made
    r = Retriever(chunks, keyword, None, Settings(mode="keyword", context_budget=500))
    rows = r.retrieve_overview(asked, "Repository map", ("README.md", FILES["README.md"])).collect()
    three = [x["role"] for x in sorted((x for x in rows if x["query_id"] == 3), key=lambda x: x["position"])]
    assert three[:1] == ["map"] and sum(x["path"] == "README.md" for x in rows if x["query_id"] == 3) == 1
    assert not any(x["role"] == "map" for x in rows if x["query_id"] != 3)


def test_connectors(spark):
    def server(url, body):
        if url.endswith("/api/embed"):
            return {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}
        return {"message": {"content": body["messages"][1]["content"].upper()}, "done_reason": "length", "eval_count": 3}

    p = models.create_provider("server", "m", transport=server)
    assert not p.sends_off_machine and models.ServerProvider("m", "https://api.example").sends_off_machine
    df = spark.createDataFrame([(1, "hi")], "query_id int, message string")
    assert complete(df, p, ["query_id"], "s").first().asDict() == {"query_id": 1, "reply": "HI", "finish": "length", "tokens_in": None, "tokens_out": 3, "error": None}
    e = models.create_embedder("server", "m", 2, batch=1, document_prefix="d: ", transport=server)
    assert e.embed_documents(["a", "bcd"]) == [[4.0, 1.0], [6.0, 1.0]] and e.embed_query("a") == [1.0, 1.0]
    with pytest.raises(models.EmbeddingError):
        models.create_embedder("server", "m", 3, transport=server).embed_query("a")
    with pytest.raises(models.EmbeddingError):
        models.create_embedder("other")
    for name in ("other", "openai"):
        with pytest.raises(ProviderError) as failed:
            models.create_provider(name, "m")
        assert failed.value.kind == "not_installed"
    with pytest.raises(ProviderError) as failed:
        models.post("http://127.0.0.1:9/", {}, 2)
    assert failed.value.kind == "unreachable"


def test_synthetic_files_and_grading_batch(spark, tmp_path, value):
    files = records.synthetic_files(spark, 20)
    assert files.count() == 20 and structured_chunks(files).where("kind = 'function'").count() == 140
    answers = spark.createDataFrame([(1, "q", "One thing. Another [1]."), (2, "q", "=x")], "result_id int, question string, answer string")
    records.grading_batch(answers, claim_rows(answers, "result_id", "answer"), str(tmp_path / "g"))
    sheet = records.load_sheet(spark, str(tmp_path / "g/claims"))
    assert sheet.count() == 3 and set(sheet.columns) == {"answer", "claim", "cites", "text", "support", "note"}
    assert spark.read.json(str(tmp_path / "g/key")).count() == 2
    assert value(text.escape_math, t="a $x$ `b $y` c\n```\n$z\n```\n") == "a \\$x\\$ `b $y` c\n```\n$z\n```\n"
