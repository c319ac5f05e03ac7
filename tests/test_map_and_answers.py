from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.functions.embedding import HashEmbedder
from quillon.functions.identifiers import query_tokens
from quillon.operators import answering, evaluation, repo_map, search
from quillon.operators.indexing import KeywordIndex
from quillon.operators.retrieval import Answerer, Retriever
from quillon.sources.settings import Settings

FILES = {
    "README.md": "# Proj\n\nA demo.\n", "pyproject.toml": "[project]\n", "src/proj/__init__.py": '"""The proj package: does the things."""\n', "src/proj/core/__init__.py": '"""Core logic."""\n',
    "src/proj/core/engine.py": '"""The engine that runs everything."""\n\nclass Engine:\n    pass\n\ndef _private():\n    pass\n\ndef start():\n    pass\n', "src/proj/api/__init__.py": '"""HTTP API."""\n', "src/proj/api/routes.py": "def route_users():\n    return 1\n",
    "tests/test_engine.py": "def test_engine():\n    assert True\n", "docs/guide.md": "# The Guide\n\nHow to use it.\n",
}
LANGUAGE = {"md": "markdown", "py": "python", "toml": "toml"}


def test_map_of_a_small_project(spark):
    rows = [("r", p, LANGUAGE[p.rsplit(".", 1)[1]], t) for p, t in FILES.items()]
    files = spark.createDataFrame(rows, "repo_id string, path string, language string, head string")
    outline = spark.createDataFrame(
        [("r", "src/proj/core/engine.py", "class", "Engine", 3, 4), ("r", "src/proj/core/engine.py", "function", "_private", 6, 7), ("r", "src/proj/core/engine.py", "function", "start", 9, 10), ("r", "src/proj/api/routes.py", "function", "route_users", 1, 2)],
        "repo_id string, path string, kind string, symbol string, start_line int, end_line int",
    )
    text = repo_map.render_map(files, outline, "r", heads=files)
    for wanted in ("9 files: python 6", "Files at the top level: README.md, pyproject.toml.", "src/proj/core/  (2 files, python) - Core logic.  defines Engine, start", "src/proj/api/  (2 files, python) - HTTP API.  defines route_users", "src/proj/  (", "Tests: tests/ (1 file).", "docs/guide.md - The Guide", "src/proj/core/engine.py - The engine that runs everything."):
        assert wanted in text, wanted
    for other in ("_private", "test_engine", "  README.md -", "__init__.py -", "\nsrc/  ("):
        assert other not in text, other
    assert len(repo_map.render_map(files, outline, "r", 60, heads=files)) < 60 * 4 + 200 and repo_map.render_map(files, outline, "none") == "(the index is empty)"


def test_benchmarks_and_answers(spark):
    rows = [(f"c{i}", f"f{i}.py", "python", "window", None, 1, 2, f"def handle_{w}(x):\n    return {w}") for i, w in enumerate(["parse", "store", "render", "fetch"])]
    chunks = spark.createDataFrame(rows, "id string, path string, language string, kind string, symbol string, start_line int, end_line int, text string")
    asked = spark.createDataFrame([(1, "where is handle_parse(x): used"), (2, "return render"), (3, "zzz")], "query_id int, question string")
    gold = spark.createDataFrame([(1, "f0.py"), (2, "f2.py")], "query_id int, path string")
    index = KeywordIndex.build(chunks)
    keyword = search.bm25(index, asked, 10)
    bench = {r["name"]: r for r in evaluation.embedding_benchmark(chunks, asked, gold, {"hash": HashEmbedder(256)}, keyword).collect()}
    assert set(bench) == {"hash", "keyword"} and bench["keyword"]["hit_1"] == 0.666667 and bench["hash"]["questions"] == 3 and {r["place"] for r in bench.values()} == {1, 2}
    ranked = search.hydrate(keyword, chunks).join(asked, "query_id")
    worst = -F.size(F.array_intersect(query_tokens(F.col("question")), F.split("text", "[^a-z_]+")))
    results = evaluation.grid_report(evaluation.rerank_ablation(ranked, asked, gold, {"overlap": search.overlap_score(F.col("question"), F.col("text")), "worst": worst}))
    mrr = {r["config"]: r["mrr"] for r in results.collect()}
    assert mrr["baseline"] == mrr["overlap"] >= mrr["worst"]
    provider = answering.ScriptedProvider(lambda m: "It is there [1]. Not [9]." if "handle_parse" in m else "None.")
    got = {r["query_id"]: r for r in Answerer(Retriever(chunks, index, settings=Settings(mode="keyword")), provider).answer(asked).collect()}
    assert (got[1]["clean_text"], got[1]["cited"], got[1]["invalid"], got[1]["sources"][0]["path"]) == ("It is there [1]. Not [?].", [1], [9], "f0.py")
    assert (got[3]["finish"], got[3]["reply"], got[3]["grounded"]) == ("no_context", None, False)


def test_ask_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def load_orders():\n    return 1\n")
    assert main(["index", str(tmp_path / "src"), str(tmp_path / "index")]) == 0
    capsys.readouterr()
    assert main(["ask", str(tmp_path / "index"), "where is load_orders", "--provider", "scripted"]) == 0
    assert capsys.readouterr().out.splitlines() == ["See [1].", "[1] a.py:1-2"]
    assert main(["ask", str(tmp_path / "none"), "x"]) == 2 and main(["ask", str(tmp_path / "index"), "where is load_orders", "--provider", "nobody"]) == 1
