import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.operators import answering, evaluation as ev, metrics, search
from quillon.sources.settings import Settings, is_local_host, load_matrix
from quillon.sources.tables import VersionedTables
from quillon.sources.vectors import VectorTable


@pytest.fixture(scope="module")
def lists(spark):
    schema = "query_id int, id string, score double, rank int"
    keyword = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2), (2, "c", 1.0, 1)], schema)
    vector = spark.createDataFrame([(1, "t", 0.9, 1), (1, "b", 0.8, 2), (2, "b", 0.7, 1)], schema)
    paths = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("c", "c.py"), ("t", "tests/t.py")], "id string, path string")
    questions = spark.createDataFrame([(1, "how does it work"), (2, "what is it")], "query_id int, question string")
    gold = spark.createDataFrame([(1, "b.py"), (2, "c.py")], "query_id int, path string")
    return keyword, vector, paths, questions, gold


def test_grid(lists):
    results = ev.evaluate(ev.ablation_grid(), *lists)
    got = {(r["config"], r["query_id"]): r["rank"] for r in results.collect()}
    assert got[("vector", 1)] == 2 and got[("vector", 2)] is None and got[("keyword", 2)] == 1 and got[("vector + demote tests", 1)] == 1 and got[("hybrid", 1)] == 1
    assert len({c for c, _ in got}) == 8
    report = {r["config"]: r for r in ev.grid_report(results).collect()}
    assert report["keyword"]["mrr"] == 0.75 and min(r["place"] for r in report.values()) == 1
    row = ev.compare(results, [("vector + demote tests", "vector")], 200).first()
    assert (row["better"], row["worse"], row["tied"]) == (1, 0, 1)
    assert [r["query_id"] for r in ev.changed_questions(results, "vector", "vector + demote tests").collect()] == [1]
    assert "| config |" in ev.markdown(ev.grid_report(results))
    with pytest.raises(ValueError):
        ev.ranked(ev.Configuration("x", "hybrid"), lists[0], None, lists[2], lists[3])
    with pytest.raises(ValueError):
        ev.ranked(ev.Configuration("x", "other"), *lists[:4])
    assert [c.changelog_penalty for c in ev.changelog_grid()] == [1.0, 0.5, 0.25]


def test_reshape_and_runs(spark):
    df = spark.createDataFrame([(1, f"p{i}", i, i) for i in range(1, 6)], "query_id int, path string, start_line int, rank int")
    assert [r["path"] for r in ev.reshape(df, "first").orderBy("position").collect()] == ["p1", "p2", "p3"]
    assert [r["path"] for r in ev.reshape(df, "reversed").orderBy("position").collect()][0] == "p5"
    a = spark.createDataFrame([("1", "same"), ("2", "abcd"), ("3", None)], "id string, answer string")
    b = spark.createDataFrame([("1", "same"), ("2", "abxy"), ("4", "z")], "id string, answer string")
    got = {r["id"]: (r["identical"], r["prefix"]) for r in ev.compare_runs(a, b).collect()}
    assert got == {"1": (True, 4), "2": (False, 2)}
    cases = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "expected boolean, got boolean")
    assert tuple(ev.classifier_report(cases).first()) == (2, 1, 2, 1)


def test_turn_pairs(spark):
    rows = [("c", 0, "system", "s"), ("c", 1, "user", "q1"), ("c", 2, "assistant", "a1"), ("c", 3, "user", "q2"), ("c", 4, "user", "q3"), ("c", 5, "assistant", "a3")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert [tuple(r)[1:] for r in answering.turn_pairs(df).orderBy("turn").collect()] == [(1, "q1", "a1"), (4, "q3", "a3")]


def test_vector_table(spark, tmp_path):
    store = VectorTable(VersionedTables(spark, str(tmp_path / "v")), 2)
    schema = "id string, path string, embedding array<float>"
    assert store.count() == 0
    store.upsert(spark.createDataFrame([("a", "a.py", [1.0, 0.0]), ("b", "b.py", [0.0, 1.0])], schema))
    store.upsert(spark.createDataFrame([("b", "b.py", [1.0, 0.1]), ("c", "c.py", [0.0, -1.0])], schema))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r["id"] for r in store.query(q, 9).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["id"] for r in store.query(q, 9, spark.createDataFrame([("b.py",)], "path string")).collect()] == ["b"]
    assert store.query(q, 9, spark.createDataFrame([], "path string")).count() == 0
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert store.count() == 2
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("d", "d", [1.0])], schema))


def test_settings(spark, tmp_path):
    assert Settings.from_environment({"QUILLON_TOP_K": "5", "QUILLON_MODE": "hybrid"}).top_k == 5
    for bad in ({"QUILLON_MODE": "x"}, {"QUILLON_TOP_K": "0"}):
        with pytest.raises(ValueError):
            Settings.from_environment(bad)
    assert all(map(is_local_host, ("http://localhost:11434", "127.0.0.1", "[::1]:80", "::1"))) and not any(map(is_local_host, ("https://api.example", "10.0.0.1", "localhost.example")))
    file = tmp_path / "m.toml"
    file.write_text('models = ["a", "b"]\nrepos = [{name = "r"}]\n[[conditions]]\nprompt = "P0"\ncontext = "live"\nmodels = ["a"]\n[[conditions]]\nprompt = "P1"\ncontext = "frozen"\n')
    from quillon.operators.study import experiment_jobs

    assert experiment_jobs(*load_matrix(spark, str(file))).count() == 3
    file.write_text("models = []")
    with pytest.raises(ValueError):
        load_matrix(spark, str(file))


def test_command_line(spark, tmp_path, capsys):
    root, place = tmp_path / "repo", str(tmp_path / "index")
    root.mkdir()
    (root / "users.py").write_text('"""Users."""\n\n\ndef create_user(name):\n    return name\n')
    (root / "test_users.py").write_text("from users import create_user\n\n\ndef test_create_user():\n    assert create_user('a') == 'a'\n")
    (root / ".env").write_text("A=1\n")
    assert main(["index", str(root), place]) == 0
    assert "2 new" in capsys.readouterr().out
    (root / "test_users.py").unlink()
    assert main(["index", str(root), place]) == 0
    out = capsys.readouterr().out
    assert "1 removed" in out and "1 unchanged" in out and "secret_file" in out
    assert main(["search", place, "create user", "-k", "3"]) == 0
    assert "users.py:4-5" in capsys.readouterr().out
    assert main(["stats", place]) == 0 and "function" in capsys.readouterr().out
    assert main(["chunks", str(root / "users.py")]) == 0 and "create_user" in capsys.readouterr().out
    questions = tmp_path / "q.jsonl"
    questions.write_text(json.dumps({"id": "q", "question": "where is create_user", "type": "locate", "gold_files": ["users.py"]}) + "\n")
    assert main(["eval", place, str(questions)]) == 0 and "| locate |" in capsys.readouterr().out
    questions.write_text("{}\n")
    assert main(["eval", place, str(questions)]) == 2
    assert main(["search", str(tmp_path / "none"), "x"]) == 2 and main(["index", str(tmp_path / "none"), place]) == 2


def test_whole_grid_equals_each_configuration_and_is_worked_out_once(spark):
    r = random.Random(4)
    ids = [f"c{i}" for i in range(40)]
    paths = [(i, r.choice(["src/a.py", "src/b.py", "tests/t.py", "CHANGELOG.md", "lib/c.go", "e2e/x.ts"])) for i in ids[:37]]  # three have none
    asked = [(q, r.choice(["how does it work", "which tests fail", "what changed in the release"])) for q in range(12)]
    some = lambda scale: [(q, i, round(r.choice([-1, 1, 2]) * r.random(), scale), n) for q in range(14) for n, i in enumerate(r.sample(ids, r.randint(1, 12)), 1)]
    schema = "query_id int, id string, score double, rank int"
    keyword, vector = spark.createDataFrame(some(1), schema), spark.createDataFrame(some(2), schema)
    named, questions = spark.createDataFrame(paths, "id string, path string"), spark.createDataFrame(asked, "query_id int, question string")
    gold = spark.createDataFrame([(q, r.choice(["src/a.py", "tests/t.py", "CHANGELOG.md", "none"])) for q in range(12)] * 2, "query_id int, path string")
    grid = [*ev.ablation_grid(), *ev.changelog_grid(), ev.Configuration("all", "hybrid", 0.0, 0.25, 0.5), ev.Configuration("k", "keyword", 3.0, 0.5, 0.5)]
    got = ev.evaluate(grid, keyword, vector, named, questions, gold)
    want = {(c.name, *x) for c in grid for x in metrics.gold_ranks(questions, search.ranked_files(ev.ranked(c, keyword, vector, named, questions)), gold).collect()}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    moves = lambda g: ev.evaluate(g, keyword, vector, named, questions, gold)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert moves(grid) == moves([*grid, ev.Configuration("more", "hybrid", 7.0, 0.5), ev.Configuration("most", "vector", 1.0, 0.1)])
    with pytest.raises(ValueError):
        ev.evaluate([ev.Configuration("x", "hybrid", -1.0)], keyword, vector, named, questions, gold)
    assert ev.evaluate([ev.Configuration("v", "vector")], None, vector, named, questions, gold).count() == 12
