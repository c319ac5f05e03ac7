"""Reports on retrieval and answers question by question: strict and lenient ranks, context, scores, frozen sources, power of a study."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.intents import overview_intent
from quillon.operators import metrics
from quillon.operators.answering import is_relevant, symbol_in_sources
from quillon.operators.repo_map import lists_directory

STRINGS = "array<string>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(STRINGS))


def lenient_files() -> Column:
    """Gold files and those that are acceptable too, without repeats."""
    return F.array_union(_list("gold_files"), _list("acceptable_files"))


# -- retrieval --------------------------------------------------------------------------------------------------------


def question_results(questions: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per question that has an answer: ``(query_id, type, rank, lenient_rank, in_context, lenient_in_context,
    symbol_in_context, area_coverage, overview, tokens, sources)``.

    ``questions`` has ``query_id, question, type, gold_files, acceptable_files, gold_symbols, gold_dirs``, ``files`` the ranked
    ``query_id, path, rank`` and ``sources`` what fitted the budget, ``query_id, path, role, text, tokens``.  Questions without
    gold symbols or directories have null there; those that found nothing have null ranks and no sources.
    """
    asked = questions.where("type is distinct from 'unanswerable'")
    asked = asked.select("query_id", "type", overview_intent(F.col("question")).isNotNull().alias("overview"), _list("gold_files").alias("gold"), lenient_files().alias("fine"), _list("gold_symbols").alias("symbols"), _list("gold_dirs").alias("dirs"))
    hit = files.join(asked.select("query_id", "gold", "fine"), "query_id").groupBy("query_id").agg(
        F.min(F.when(F.array_contains("gold", F.col("path")), F.col("rank"))).alias("rank"), F.min(F.when(F.array_contains("fine", F.col("path")), F.col("rank"))).alias("lenient_rank")
    )
    shown = sources.groupBy("query_id").agg(F.collect_set("path").alias("paths"), F.collect_list("text").alias("texts"), F.collect_list(F.when(F.col("role") == "map", F.col("text"))).alias("maps"), F.sum("tokens").alias("tokens"), F.count("*").alias("sources"))
    rows = asked.join(hit, "query_id", "left").join(shown, "query_id", "left")
    for name in ("paths", "texts", "maps"):
        rows = rows.withColumn(name, _list(name))
    inside = lambda d: F.exists("paths", lambda p: p.startswith(F.concat(F.regexp_replace(d, "^/+|/+$", ""), F.lit("/"))))
    mentioned = lambda d: F.exists("maps", lambda m: lists_directory(m, d))
    covered = F.size(F.filter("dirs", lambda d: inside(d) | mentioned(d)))
    return rows.select(
        "query_id", "type", "rank", "lenient_rank", F.arrays_overlap("paths", "gold").alias("in_context"), F.arrays_overlap("paths", "fine").alias("lenient_in_context"), symbol_in_sources(F.col("symbols"), F.col("texts")).alias("symbol_in_context"),
        F.when(F.size("dirs") > 0, F.round(covered / F.size("dirs"), 6)).alias("area_coverage"), "overview", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("sources", F.lit(0)).alias("sources"),
    )


def retrieval_summary() -> list[Column]:
    """The measures of a retrieval report; what is null for a question stays out of its mean."""
    share = lambda c, name: F.round(F.avg(F.col(c).cast("int")), 6).alias(name)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return [
        F.count("*").alias("questions"), *metrics.ranking_summary("rank", prefix="strict_"), *metrics.ranking_summary("lenient_rank", prefix="lenient_"), share("in_context", "context_recall"), share("lenient_in_context", "lenient_context_recall"),
        share("symbol_in_context", "symbol_in_context"), mean("area_coverage", "area_coverage"), share("overview", "overview_rate"), mean("tokens", "avg_tokens"), mean("sources", "avg_sources"),
    ]


def retrieval_report(results: DataFrame) -> DataFrame:
    """The summary of each type and, under ``(all)``, of all questions."""
    out = results.rollup("type").agg(F.grouping("type").alias("whole"), *retrieval_summary())
    return out.withColumn("type", F.when(F.col("whole") == 1, "(all)").otherwise(F.col("type"))).drop("whole")


def pooled(suites: dict[str, DataFrame]) -> DataFrame:
    """Results of several question files in one table, ``suite`` names each."""
    parts = [r.withColumn("suite", F.lit(name)) for name, r in suites.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview_report(plain: DataFrame, with_map: DataFrame, others: DataFrame) -> DataFrame:
    """``(setting, questions, area_coverage, recognised, avg_tokens)`` without and with a map, and ``false_flags`` among ``others``.

    ``plain`` and ``with_map`` are ``question_results`` of overview questions, ``others`` of questions that aren't.
    """
    one = lambda r, name: r.agg(F.lit(name).alias("setting"), F.count("*").alias("questions"), F.round(F.avg("area_coverage"), 6).alias("area_coverage"), F.round(F.avg(F.col("overview").cast("int")), 6).alias("recognised"), F.round(F.avg("tokens"), 2).alias("avg_tokens"))
    flagged = others.agg(F.count_if("overview").alias("false_flags"), F.count("*").alias("other_questions"))
    return one(plain, "plain").unionByName(one(with_map, "map")).crossJoin(flagged)  # one row each


def find_chunks(chunks: DataFrame, path: str, symbol: str | None = None, kind: str | None = None) -> DataFrame:
    """The chunks of a path, of one symbol or kind if given, in the order of their lines."""
    rows = chunks.where(F.col("path") == path)
    for name, value in (("symbol", symbol), ("kind", kind)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy("start_line", "end_line", "id")


# -- frozen retrieval ---------------------------------------------------------------------------------------------------


class FrozenMismatchError(ValueError):
    """Frozen sources were made under other settings than those of the run."""


def freeze(sources: DataFrame, questions: DataFrame, folder: str, meta: dict[str, str]) -> None:
    """Write the sources of each question by its text, so that runs of many models see the same; existing folders are refused."""
    named = sources.join(questions.select("query_id", "question"), "query_id").withColumn("meta", F.create_map(*[F.lit(x) for pair in sorted(meta.items()) for x in pair]))
    named.write.parquet(folder)


def replay(spark: SparkSession, folder: str, questions: DataFrame, **expected: str) -> DataFrame:
    """Frozen sources of questions by their text, under the questions' own ids; raises where a setting differs."""
    rows = spark.read.parquet(folder)
    for name, value in expected.items():
        other = rows.where(~F.col("meta")[name].eqNullSafe(F.lit(value))).limit(1).collect()
        if other:
            raise FrozenMismatchError(f"{name} is {other[0]['meta'].get(name)!r}, not {value!r}")
    return rows.drop("query_id", "meta").join(questions.select("query_id", "question"), "question").drop("question")


def supplied(answers: DataFrame, frozen: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``gold_supplied``: whether a gold file was among the frozen sources of an answer's question; null without frozen ones.

    ``answers`` has ``question``, ``frozen`` has ``question, path`` and ``gold`` has ``question, path``.
    """
    hit = frozen.join(gold.select("question", "path").distinct().withColumn("gold", F.lit(1)), ["question", "path"], "left")
    per = hit.groupBy("question").agg((F.max("gold") == 1).alias("any"), F.lit(True).alias("known"))
    return answers.join(per, "question", "left").withColumn("gold_supplied", F.when(F.col("known"), F.coalesce("any", F.lit(False)))).drop("any", "known")


# -- answers ------------------------------------------------------------------------------------------------------------


def score_answers(reports: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores of answers against gold: ``(query_id, type, grounded, validity, precision, gold_cited, uncited_share, unverified_locations, refused, truncated, no_context)``.

    ``reports`` is ``citation_report`` with ``query_id, finish, sources`` kept; ``sources`` is an array of ``struct<path, start_line,
    end_line, text, role>``.  Precision is the share of cited sources that bear on the question, null where none is cited or the
    question has no answer; ``gold_cited`` is null there too.
    """
    asked = questions.select("query_id", "type", lenient_files().alias("fine"), _list("gold_dirs").alias("dirs"), _list("gold_symbols").alias("symbols"))
    rows = reports.join(asked, "query_id").withColumn("used", F.transform("cited", lambda n: F.element_at("sources", n)))
    kind, fine, dirs, symbols = (F.col(c) for c in ("type", "fine", "dirs", "symbols"))
    good = F.size(F.filter("used", lambda s: is_relevant(s["role"], s["path"], s["text"], kind, fine, dirs, symbols)))
    answerable = ~kind.eqNullSafe(F.lit("unanswerable"))
    return rows.select(
        "query_id", "type", "grounded", "validity", F.when(answerable & (F.size("used") > 0), F.round(good / F.size("used"), 6)).alias("precision"), F.when(answerable, F.exists("used", lambda s: F.array_contains(fine, s["path"]))).alias("gold_cited"),
        F.when(F.size("sources") > 0, F.round(F.size("uncited") / F.size("sources"), 6)).alias("uncited_share"), F.size("unverified_locations").alias("unverified_locations"), (F.col("finish") == "refusal").alias("refused"),
        (F.col("finish") == "length").alias("truncated"), (F.col("finish") == "no_context").alias("no_context"),
    )


# -- power and scale ------------------------------------------------------------------------------------------------------


def noninferiority_power(grid: DataFrame, simulations: int = 20_000, seed: int = 0) -> DataFrame:
    """Adds ``power`` to ``(n, discordance, difference, margin)``: how often the 95 % interval of a paired difference lies above the margin."""

    def run(batches):
        for b in batches:
            rng = np.random.default_rng(seed)
            power = []
            for n, disc, diff, margin in zip(b["n"], b["discordance"], b["difference"], b["margin"]):
                up, down = max(0.0, (disc + diff) / 2), max(0.0, (disc - diff) / 2)
                draws = rng.multinomial(int(n), [up, down, max(0.0, 1 - up - down)], size=simulations)
                d = (draws[:, 0] - draws[:, 1]) / n
                error = np.sqrt(np.maximum((draws[:, 0] + draws[:, 1]) / n - d * d, 0) / n)
                power.append(float((d - 1.959964 * error > margin).mean()))
            yield b.assign(power=power)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema)
    return grid.mapInPandas(run, f"{types}, power double")


def index_times(runs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """``(*by, runs, median_seconds)`` of repeated runs."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.median("seconds"), 6).alias("median_seconds"))


def scale_test(spark: SparkSession, folder: str, sizes: Sequence[int]) -> DataFrame:
    """Builds an index of made-up files at each size: seconds to build and to run again without changes, of a search, and bytes."""
    from quillon.operators.indexing import KeywordIndex
    from quillon.operators.search import bm25
    from quillon.session import FileSystem
    from quillon.sources.records import synthetic_files
    from quillon.sources.tables import VersionedTables
    from quillon.streaming.incremental import apply_batch

    rows = []
    for n in sizes:
        tables, files = VersionedTables(spark, f"{folder}/n{n}"), synthetic_files(spark, n)
        began = time.time()
        apply_batch(tables, files)
        built = time.time()
        apply_batch(tables, files)
        again = time.time()
        index = KeywordIndex.build(tables.read("chunks"))
        asked = spark.createDataFrame([(k, f"where is handle_{k}_1 defined") for k in range(4)], "query_id int, question string")
        start = time.time()
        bm25(index, asked, 10).count()
        rows.append((n, tables.read("chunks").count(), built - began, again - built, (time.time() - start) / 4, FileSystem(spark, folder).size(f"{folder}/n{n}")))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["files", "chunks", "index_seconds", "unchanged_seconds", "search_seconds", "bytes"]))

