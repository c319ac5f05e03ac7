import math

import pytest
from pyspark.sql import functions as F

from quillon.functions.citations import citation_report
from quillon.operators import answering, assessment, study

QUESTIONS = "query_id int, question string, type string, gold_files array<string>, acceptable_files array<string>, gold_symbols array<string>, gold_dirs array<string>"


@pytest.fixture(scope="module")
def asked(spark):
    rows = [
        (1, "Where is f?", "locate", ["a.py"], None, ["C.f"], None), (2, "What does this project do?", "overview", None, None, None, ["src", "docs/"]), (3, "Where is g?", "locate", ["z.py"], ["b.py"], None, None),
        (4, "Is there a k?", "unanswerable", None, None, None, None), (5, "Where is nothing?", "locate", ["q.py"], [], ["h"], None),
    ]
    return spark.createDataFrame(rows, QUESTIONS)


def test_question_results_and_report(spark, asked):
    files = spark.createDataFrame([(1, "b.py", 1), (1, "a.py", 2), (3, "b.py", 1), (4, "a.py", 1)], "query_id int, path string, rank int")
    sources = spark.createDataFrame([(1, "a.py", "match", "def f(): pass", 10), (2, "(map)", "map", "docs/  (2 files, markdown)", 5), (2, "lib/x.py", "match", "x", 5), (3, "b.py", "match", "y", 7)], "query_id int, path string, role string, text string, tokens int")
    rows = assessment.question_results(asked, files, sources)
    got = {r["query_id"]: r for r in rows.collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1]["rank"], got[1]["lenient_rank"], got[1]["in_context"], got[1]["symbol_in_context"], got[1]["tokens"]) == (2, 2, True, True, 10)
    assert (got[2]["area_coverage"], got[2]["overview"], got[2]["symbol_in_context"]) == (0.5, True, None)
    assert (got[3]["rank"], got[3]["lenient_rank"], got[3]["in_context"], got[3]["lenient_in_context"]) == (None, 1, False, True)
    assert (got[5]["rank"], got[5]["in_context"], got[5]["symbol_in_context"], got[5]["sources"]) == (None, False, False, 0)
    report = {r["type"]: r for r in assessment.retrieval_report(rows).collect()}
    assert report["(all)"]["questions"] == 4 and report["(all)"]["strict_mrr"] == 0.125 and report["locate"]["lenient_hit_1"] == pytest.approx(1 / 3, abs=1e-6)
    assert report["(all)"]["context_recall"] == 0.25 and report["(all)"]["symbol_in_context"] == 0.5 and report["overview"]["area_coverage"] == 0.5
    assert assessment.pooled({"a": rows, "b": rows}).count() == 8
    over = {r["setting"]: r for r in assessment.overview_report(rows.where("type = 'overview'"), rows.where("type = 'overview'"), rows.where("type = 'locate'")).collect()}
    assert over["map"]["area_coverage"] == 0.5 and over["plain"]["false_flags"] == 0 and over["plain"]["other_questions"] == 3
    assert assessment.retrieval_report(rows.limit(0)).where("questions > 0").count() == 0


SOURCES = "array<struct<path string, start_line int, end_line int, text string, role string>>"


def test_scores_of_answers(spark, asked):
    two = [("a.py", 1, 9, "def f(): pass", "match"), ("n.py", 1, 9, "no", "match")]
    rows = [(1, "It is there [1]. Or here [2][7].", "stop", two), (3, "None.", "stop", two), (4, "No [1].", "stop", two), (5, "Sorry.", "refusal", [])]
    answers = spark.createDataFrame(rows, f"query_id int, reply string, finish string, sources {SOURCES}")
    spans = answers.withColumn("spans", F.expr("transform(sources, s -> struct(s.path, s.start_line, s.end_line))"))
    reports = citation_report(spans, "reply", "spans", ["query_id", "finish"]).join(answers.select("query_id", "sources"), "query_id")
    got = {r["query_id"]: r for r in assessment.score_answers(reports, asked).collect()}
    assert (got[1]["precision"], got[1]["gold_cited"], got[1]["uncited_share"], round(got[1]["validity"], 3)) == (0.5, True, 0.0, 0.667)
    assert (got[3]["precision"], got[3]["gold_cited"], got[3]["grounded"], got[3]["uncited_share"]) == (None, False, False, 1.0)
    assert (got[4]["precision"], got[4]["gold_cited"]) == (None, None) and got[5]["refused"] and got[5]["uncited_share"] is None


def test_frozen_sources(spark, asked, tmp_path):
    sources = spark.createDataFrame([(1, "a.py", 1), (3, "b.py", 1)], "query_id int, path string, rank int")
    assessment.freeze(sources, asked, str(tmp_path / "f"), {"mode": "hybrid"})
    other = asked.withColumn("query_id", F.col("query_id") + 100)
    got = assessment.replay(spark, str(tmp_path / "f"), other, mode="hybrid")
    assert sorted((r["query_id"], r["path"]) for r in got.collect()) == [(101, "a.py"), (103, "b.py")]
    with pytest.raises(assessment.FrozenMismatchError):
        assessment.replay(spark, str(tmp_path / "f"), other, mode="vector")
    frozen, gold = sources.join(asked, "query_id").select("question", "path"), asked.select("question", F.explode("gold_files").alias("path"))
    got = {r["query_id"]: r["gold_supplied"] for r in assessment.supplied(asked.select("query_id", "question"), frozen, gold).collect()}
    assert got == {1: True, 2: None, 3: False, 4: None, 5: None}


def test_judging(spark):
    rows = [(1, "q", "a [1]", [("a.py", 1, 2, "code", "match")], [1], "[1]"), (2, "q", "a", [("a.py", 1, 2, "code", "match")], [], "")]
    df = spark.createDataFrame(rows, f"k int, question string, reply string, sources {SOURCES}, cited array<int>, cites string").withColumn("text", F.col("reply"))
    judge = answering.ScriptedProvider(lambda m: '{"verdict": "supported", "label": "contradicted", "reason": "r"}' if "[1] a.py:1-2\ncode" in m else "?")
    got = {r["k"]: r for r in answering.judge_answers(df, judge, ["k"]).collect()}
    assert (got[1]["verdict"], got[1]["error"]) == ("supported", None) and (got[2]["verdict"], got[2]["error"], got[2]["reason"]) == (None, None, "nothing is cited")
    cut = answering.judge_answers(df, answering.ScriptedProvider("{", finish="length"), ["k"]).where("k = 1").first()
    assert cut["verdict"] is None and "length" in cut["error"]
    got = {r["k"]: r for r in answering.judge_claims(df, judge, ["k"]).collect()}
    assert (got[1]["label"], got[1]["by"]) == ("contradicted", "judge") and (got[2]["label"], got[2]["by"], got[2]["error"]) == ("unsupported", "rule", None)


def test_primary_comparisons_of_a_study_worked_out_by_hand(spark):
    """Two models, two repositories, eight questions; one answer of the small model failed."""
    seven, four = "coder:7b", "small:4b"
    ids = [("r1", q) for q in ("a1", "a2", "a3", "a4")] + [("r2", q) for q in ("b1", "b2", "b3", "b4")]
    every = {q for _, q in ids}
    grounded = {(seven, "P0"): {"a1", "a4", "b3"}, (seven, "P1"): every, (seven, "P3"): every, (four, "P0"): set(), (four, "P1"): {"a1", "a2", "a3", "a4"}}
    answers, grades, claims, judges = [], [], [], []
    for (model, prompt), yes in grounded.items():
        for repo, q in ids:
            failed, g = (model, prompt, q) == (four, "P1", "b4"), q in yes
            file = f"{repo}/{prompt}/{model}"
            answers.append((file, model, repo, prompt, "frozen", q, failed, g, (1.0 if prompt == "P3" else 0.5) if g else None))
            if model == seven and (prompt != "P3" or q in ("a1", "a2")):
                code = f"{prompt}-{q}"
                grades.append((code, file, q, "main", "wrong" if (prompt, q) in {("P0", "a4"), ("P1", "b4")} else "correct"))
                labels = ["supported" if g else "unsupported", "not a claim" if (prompt, q) == ("P1", "b4") else "unsupported"]
                for n, label in enumerate(labels, 1):
                    claims.append((code, file, q, n, "main", label))
                    judges.append(("judge:8b", file, q, n, "supported" if n == 1 and g else "unsupported"))
    frame = spark.createDataFrame
    tables = (
        frame(answers, "results_file string, model string, repo string, prompt string, context string, question_id string, failed boolean, grounded boolean, precision double"), frame(grades, "code string, results_file string, question_id string, grader string, correctness string"),
        frame(claims, "code string, results_file string, question_id string, claim int, grader string, label string"), frame(judges, "judge string, results_file string, question_id string, claim int, label string"),
    )
    itt = {r["id"]: r for r in study.primary_comparisons(*tables, resamples=400).collect()}
    complete = {r["id"]: r for r in study.primary_comparisons(*tables, drop_failed=True, resamples=400).where("id = 'C1'").collect()}
    assert itt["C1"]["estimate"] == pytest.approx(4.5 / 8) and complete["C1"]["estimate"] == pytest.approx(5 / 8)
    assert itt["C1"]["low"] <= itt["C1"]["estimate"] <= itt["C1"]["high"]
    assert itt["C2"]["estimate"] == pytest.approx(0) and itt["C3a"]["estimate"] == pytest.approx(0.5) and itt["C3b"]["p"] == 1.0
    assert itt["C4 judge:8b"]["estimate"] == pytest.approx(1.0) and (itt["C5"]["estimate"], itt["C5"]["n"]) == (1.0, 1)
    assert all(r["p_holm"] >= r["p"] for r in itt.values()) and set(itt) == {"C1", "C2", "C3a", "C3b", "C4 judge:8b", "C5"}


def test_power_times_and_scale(spark, tmp_path):
    grid = spark.createDataFrame([(400, 0.2, 0.0, -0.1), (20, 0.2, 0.0, -0.1)], "n int, discordance double, difference double, margin double")
    power = {r["n"]: r["power"] for r in assessment.noninferiority_power(grid, 2_000).collect()}
    assert power[400] > 0.95 > 0.6 > power[20] and all(not math.isnan(p) for p in power.values())
    runs = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", 9.0)], "model string, seconds double")
    assert assessment.index_times(runs).first()["median_seconds"] == 3.0
    row = assessment.scale_test(spark, str(tmp_path / "s"), [20]).first()
    assert row["files"] == 20 and row["chunks"] >= 20 and row["bytes"] > 0
    chunks = spark.createDataFrame([("1", "a.py", "f", "function", 9, 9), ("2", "a.py", "f", "function", 1, 3), ("3", "b.py", "f", "function", 1, 3)], "id string, path string, symbol string, kind string, start_line int, end_line int")
    assert [r["id"] for r in assessment.find_chunks(chunks, "a.py", "f").collect()] == ["2", "1"]
