"""Every registered query of the core against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillon.operators import evaluation, statistics
from quillon.plans import oracles, queries

DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        return f"{round(float(x), 6):.6f}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.execute(oracles.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["structured_coverage", "citations", "claim_sentences", "scripted_answers", "retrieved_sources", "file_descriptions"])
def test_query_runs(spark, name):
    rows = queries.queries()[name](spark, DATA)
    assert rows.count() > 0
    if name == "structured_coverage":
        assert [r["complete"] for r in rows.collect()] == [True]


def test_retrieved_sources_are_lines_of_their_files(spark):
    rows = queries._sources(spark, DATA).select("path", "start_line", "end_line", "text")
    files = queries.files(spark, DATA).selectExpr("concat_ws('/', repo_id, path) as path", "split(text, '\n', -1) as lines")
    both = rows.join(files, "path").selectExpr("text", "array_join(slice(lines, start_line, end_line - start_line + 1), '\n') as want").collect()
    assert both and sum(r["text"] == r["want"] for r in both) >= 0.9 * len(both)  # a few files changed after they were indexed


def test_hybrid_sources_run_the_whole_chain(spark):
    rows = queries.queries()["hybrid_sources"](spark, DATA).collect()
    asked = {r["query_id"] for r in queries.questions(spark, DATA).collect()}
    assert asked and {r["query_id"] for r in rows} == asked
    assert all(r["start_line"] <= r["end_line"] for r in rows) and len({(r["query_id"], r["path"], r["start_line"]) for r in rows}) == len(rows)


def test_bootstraps_draw_the_full_number_of_resamples(spark, monkeypatch):
    drawn = []
    for module, name in ((statistics, "paired_bootstrap"), (statistics, "cluster_bootstrap"), (evaluation, "compare")):
        monkeypatch.setattr(module, name, lambda *a, resamples=statistics.RESAMPLES, **k: drawn.append(resamples))
    monkeypatch.setattr(queries, "_grid_results", lambda *a: None)
    for name in ("paired_bootstrap", "prompt_bootstrap", "ablation_pairs"):
        queries.queries()[name](spark, DATA)
    assert drawn == [10_000] * 3


def test_every_sql_has_its_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())
