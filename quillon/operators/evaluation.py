"""Evaluations of search settings: a grid of configurations over one question set, reports, paired comparisons and replays."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.embedding import embed
from quillon.functions.paths import is_changelog_path, is_test_path, mentions_changes, mentions_tests
from quillon.operators import metrics, search, statistics
from quillon.session import stored


@dataclass(frozen=True)
class Configuration:
    name: str
    mode: str  # vector, keyword, hybrid
    keyword_weight: float = 1.0
    test_penalty: float = 1.0  # 1 is off
    changelog_penalty: float = 1.0


def ablation_grid(keyword_weights: Sequence[float] = (0.5, 2.0), test_penalty: float = 0.5) -> list[Configuration]:
    """Each searcher alone, both fused with several weights, and the main ones with test files demoted."""
    plain = [Configuration("vector", "vector"), Configuration("keyword", "keyword"), Configuration("hybrid", "hybrid"), *(Configuration(f"hybrid kw={w:g}", "hybrid", w) for w in keyword_weights)]
    demoted = [c for c in plain if c.name in ("vector", "hybrid", "hybrid kw=0.5")]
    return [*plain, *(Configuration(f"{c.name} + demote tests", c.mode, c.keyword_weight, test_penalty) for c in demoted)]


def changelog_grid(penalties: Sequence[float] = (1.0, 0.5, 0.25)) -> list[Configuration]:
    return [Configuration(f"changelog x{p:g}", "vector", 1.0, 0.5, p) for p in penalties]


def _check(configuration: Configuration, keyword: DataFrame | None, vector: DataFrame | None) -> None:
    if configuration.mode not in ("vector", "keyword", "hybrid"):
        raise ValueError(f"unknown mode {configuration.mode!r}")
    if configuration.mode != "keyword" and vector is None or configuration.mode != "vector" and keyword is None:
        raise ValueError(f"{configuration.mode} search needs a list that is missing")


def ranked(configuration: Configuration, keyword: DataFrame | None, vector: DataFrame | None, paths: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, id, path, score, rank)`` of one configuration; the searchers' lists are given, so they are made once."""
    _check(configuration, keyword, vector)
    hits = vector if configuration.mode == "vector" else keyword if configuration.mode == "keyword" else search.hybrid(keyword, vector, configuration.keyword_weight)
    named = hits.select("query_id", "id", "score", "rank").join(paths.select("id", "path"), "id").join(questions.select("query_id", "question"), "query_id")
    return search.penalise_paths(named, configuration.test_penalty, configuration.changelog_penalty).select("query_id", "id", "path", "score", "rank")


def evaluate(configurations: Sequence[Configuration], keyword: DataFrame | None, vector: DataFrame | None, paths: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """``(config, query_id, rank)``: the first gold file's place for every configuration and question, as one table.

    What ``ranked`` gives for one configuration is worked out for all of them together: hits get their paths and whether those
    are gold once, equal lists are made once, and from then on everything is grouped by question.  ``paths`` has a row per id.
    """
    for c in configurations:
        _check(c, keyword, vector)
    spark = questions.sparkSession
    flagged = paths.select("id", "path", is_test_path(F.col("path")).alias("test"), is_changelog_path(F.col("path")).alias("note"))
    wanted = gold.select("query_id", "path").distinct().withColumn("gold", F.lit(True))
    asked = questions.select("query_id", mentions_tests(F.col("question")).alias("tests"), mentions_changes(F.col("question")).alias("notes"))
    lists = [x.select("query_id", "id", "score", "rank", F.lit(n).alias("list")) for n, x in ((0, vector), (1, keyword)) if x is not None]
    hits = stored(reduce(DataFrame.unionByName, lists).join(flagged, "id", "left").join(wanted, ["query_id", "path"], "left")).repartition("query_id")
    weights = list(dict.fromkeys(c.keyword_weight for c in configurations if c.mode == "hybrid"))
    found = ["path", "test", "note", "gold"]
    plain = hits.select("query_id", "id", "score", "rank", *found, F.when(F.col("list") == 0, "vector").otherwise("keyword").alias("mode"), F.lit(0.0).alias("weight"))
    if weights:
        fused = search.fuse_lists(hits, [[1.0, w] for w in weights], keep=found).withColumns({"mode": F.lit("hybrid"), "weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("weighting"))})
        plain = plain.unionByName(fused.select(*plain.columns))
    settings = [(c.mode, float(c.keyword_weight) if c.mode == "hybrid" else 0.0, n, float(c.test_penalty), float(c.changelog_penalty)) for n, c in enumerate(configurations)]
    grid = F.broadcast(spark.createDataFrame(settings, "mode string, weight double, number int, test_penalty double, changelog_penalty double"))
    rows = plain.where("path is not null").join(asked, "query_id").join(grid, ["mode", "weight"])
    tests, notes = ((F.col(p) < 1.0) & ~F.col(q) & F.col(f) for p, q, f in (("test_penalty", "tests", "test"), ("changelog_penalty", "notes", "note")))
    lowered = search.penalise(rows, F.when(tests, F.col("test_penalty")).when(notes, F.col("changelog_penalty")).otherwise(1.0), "number")
    files = lowered.groupBy("query_id", "number", "path").agg(F.min("rank").alias("chunk_rank"), F.max("gold").alias("gold"))
    place = F.row_number().over(Window.partitionBy("query_id", "number").orderBy("chunk_rank", "path"))
    hit = files.withColumn("rank", place).where("gold").groupBy("query_id", "number").agg(F.min("rank").alias("rank"))
    names = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(c.name).alias("config")) for n, c in enumerate(configurations)])
    return questions.select("query_id", F.inline(names)).join(hit, ["query_id", "number"], "left").select("config", "query_id", "rank")


def grid_report(results: DataFrame) -> DataFrame:
    """Hit rates and reciprocal rank of each configuration, with its place among them."""
    out = results.groupBy("config").agg(F.count("*").alias("questions"), *metrics.ranking_summary())
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("hit_5"), "config")))  # a row per configuration


def pairs_of(results: DataFrame, comparisons: Sequence[tuple[str, str]], cutoff: int = 10) -> DataFrame:
    """``(pair, query_id, a, b)``: reciprocal ranks of two configurations on the same questions."""
    parts = []
    for first, second in comparisons:
        a = results.where(F.col("config") == first).select("query_id", metrics.reciprocal_rank(F.col("rank"), cutoff).alias("a"))
        b = results.where(F.col("config") == second).select("query_id", metrics.reciprocal_rank(F.col("rank"), cutoff).alias("b"))
        parts.append(a.join(b, "query_id").select(F.lit(f"{first} vs {second}").alias("pair"), "query_id", "a", "b"))
    return reduce(DataFrame.unionByName, parts)


def compare(results: DataFrame, comparisons: Sequence[tuple[str, str]], resamples: int = 10_000) -> DataFrame:
    """Differences, wins and losses with their exact p-value and bootstrap interval, a row per comparison."""
    pairs = pairs_of(results, comparisons)
    counts = statistics.paired_counts(pairs, "a", "b", ["pair"])
    boot = statistics.paired_bootstrap(pairs, "a", "b", "pair", "query_id", resamples).select("pair", "ci_low", "ci_high", "significant")
    return counts.join(boot, "pair")


def changed_questions(results: DataFrame, first: str, second: str) -> DataFrame:
    """Questions whose rank differs between two configurations; found against not found counts."""
    a, b = (results.where(F.col("config") == c).select("query_id", F.col("rank").alias(n)) for c, n in ((first, "before"), (second, "after")))
    return a.join(b, "query_id").where(~F.col("before").eqNullSafe(F.col("after")))


def reshape(sources: DataFrame, how: str, first: int = 3) -> DataFrame:
    """Frozen sources shown differently: only the ``first`` of each question, or all in ``reversed`` order; ``position`` says where."""
    place = Window.partitionBy("query_id").orderBy("rank", "path", "start_line")
    rows = sources.withColumns({"position": F.row_number().over(place), "_n": F.count("*").over(Window.partitionBy("query_id"))})
    if how == "first":
        return rows.where(F.col("position") <= first).drop("_n")
    if how == "reversed":
        return rows.withColumn("position", F.col("_n") - F.col("position") + 1).drop("_n")
    raise ValueError(f"unknown shape {how!r}")


def same_prefix(a: Column, b: Column) -> Column:
    """``struct<prefix, ratio>``: characters two texts begin with in common, and how alike they are."""

    @F.pandas_udf("prefix int, ratio double")
    def of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y):
            p, q = p or "", q or ""
            n = next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
            rows.append((n, round(SequenceMatcher(None, p, q, autojunk=False).ratio(), 6)))
        return pd.DataFrame(rows, columns=["prefix", "ratio"])

    return of(a, b)


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(id, identical, prefix, ratio)`` of two runs' answers by question id; questions of one run alone are left out."""
    both = first.select("id", F.col("answer").alias("a")).join(second.select("id", F.col("answer").alias("b")), "id")
    return both.select("id", F.col("a").eqNullSafe(F.col("b")).alias("identical"), same_prefix(F.col("a"), F.col("b")).alias("s")).select("id", "identical", "s.*")


def classifier_report(cases: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    """One row: recall over cases that should be flagged, and how many others were."""
    e, g = F.col(expected), F.col(got)
    return cases.agg(F.count_if(e).alias("positive"), F.count_if(e & g).alias("found"), F.count_if(~e).alias("negative"), F.count_if(~e & g).alias("false_flags"))


def embedding_benchmark(chunks: DataFrame, questions: DataFrame, gold: DataFrame, embedders: dict, keyword: DataFrame | None = None, k: int = 40, shown: int = 10) -> DataFrame:
    """``(name, questions, hit_1 ... mrr, seconds, place)`` of each embedder, and of a keyword ranking beside them.

    Each searches its ``k`` best chunks, whose first ``shown`` different files count.  ``seconds`` is the time to embed all chunks.
    """
    parts = []
    for name, embedder in embedders.items():
        began = time.time()
        vectors = stored(embed(chunks, embedder, ["id"], "text"))
        seconds = time.time() - began
        hits = search.cosine(vectors, embed(questions, embedder, ["query_id"], "question"), k, id_col="id")
        parts.append((name, hits, seconds))
    if keyword is not None:
        parts.append(("keyword", keyword.where(F.col("rank") <= k), 0.0))
    rows = []
    for name, hits, seconds in parts:
        files = search.ranked_files(search.hydrate(hits, chunks.select("id", "path"))).where(F.col("rank") <= shown)
        rows.append(metrics.gold_ranks(questions, files, gold).agg(F.lit(name).alias("name"), F.count("*").alias("questions"), *metrics.ranking_summary(), F.lit(round(seconds, 3)).alias("seconds")))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), F.desc("hit_5"), "seconds", "name")))  # a row per embedder


def rerank_ablation(ranked_chunks: DataFrame, questions: DataFrame, gold: DataFrame, scores: dict[str, Column], head: int = 30) -> DataFrame:
    """``(config, query_id, rank)`` without reranking and with each of the scores, all over one ranking."""
    lists = {"baseline": ranked_chunks} | {name: search.rerank(ranked_chunks, score, head) for name, score in scores.items()}
    parts = [metrics.gold_ranks(questions, search.ranked_files(rows), gold).withColumn("config", F.lit(name)) for name, rows in lists.items()]
    return reduce(DataFrame.unionByName, parts).select("config", "query_id", "rank")


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small table as markdown, for a report of one reader."""
    shown = rows.limit(limit).collect()
    text = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in shown)])
