"""Measures of retrieval and of answers as grouped aggregates; what is undefined is null and stays out of means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
VERDICTS = ("unsupported", "partially_supported", "supported")


def reciprocal_rank(rank: Column, cutoff: int = 10) -> Column:
    return F.when(rank <= cutoff, 1.0 / rank).otherwise(0.0)


def gold_ranks(questions: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``(query_id, rank)``: the place of the first gold file; null where none is ranked.

    ``ranked`` has ``query_id, path, rank``, ``gold`` has ``query_id, path``; every question gives a row.
    """
    hit = ranked.join(gold.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.select("query_id").join(hit, "query_id", "left")


def ranking_summary(rank: str = "rank", ks: Sequence[int] = KS, prefix: str = "") -> list[Column]:
    """Aggregates: share of questions with a hit in the first k, and the mean reciprocal rank cut at the largest k."""
    c = F.col(rank)
    hits = [F.round(F.avg(F.when(c <= k, 1.0).otherwise(0.0)), 6).alias(f"{prefix}hit_{k}") for k in ks]
    return [*hits, F.round(F.avg(reciprocal_rank(c, max(ks))), 6).alias(f"{prefix}mrr")]


def ranking_report(results: DataFrame, group: str = "type") -> DataFrame:
    """The summary of each type and, under ``(all)``, of all questions."""
    out = results.rollup(group).agg(F.grouping(group).alias("whole"), F.count("*").alias("questions"), *ranking_summary())
    return out.withColumn(group, F.when(F.col("whole") == 1, "(all)").otherwise(F.col(group))).drop("whole")


def misses(results: DataFrame, k: int = 5) -> DataFrame:
    return results.where(F.col("rank").isNull() | (F.col("rank") > k))


def area_coverage(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """``(query_id, coverage)``: the share of the wanted directories of which a file is shown.

    ``wanted`` has ``query_id, directory``, ``shown`` has ``query_id, path``; questions without wanted directories give no row.
    """
    from quillon.functions.paths import directories

    above = shown.select("query_id", F.explode(directories(F.col("path"))).alias("directory")).distinct().withColumn("hit", F.lit(1))
    clean = wanted.select("query_id", F.regexp_replace("directory", "^/+|/+$", "").alias("directory")).distinct()
    return clean.join(above, ["query_id", "directory"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"))


def answer_summary(*group: str) -> list[Column]:
    """The measures of an answer report; judged answers are those with a ``verdict``, failed ones have an ``error``."""
    ok = F.col("error").isNull()
    mean = lambda c, name: F.round(F.avg(F.when(ok, c.cast("double"))), 6).alias(name)
    return [
        F.count("*").alias("questions"),
        F.count_if(~ok).alias("errors"),
        mean(F.coalesce("grounded", F.lit(False)).cast("int"), "grounded_rate"),
        mean(F.col("validity"), "citation_validity"),
        mean(F.col("citation_precision"), "mean_precision"),
        mean(F.col("gold_cited").cast("int"), "gold_cited_rate"),
        mean(F.col("uncited_share"), "mean_uncited_share"),
        mean((F.coalesce("unverified_locations", F.lit(0)) > 0).cast("int"), "unverified_location_rate"),
        mean(F.coalesce("refused", F.lit(False)).cast("int"), "refusal_rate"),
        mean(F.coalesce("truncated", F.lit(False)).cast("int"), "truncation_rate"),
        mean(F.col("tokens_in"), "avg_tokens_in"),
        mean(F.col("tokens_out"), "avg_tokens_out"),
        mean(F.col("seconds"), "avg_seconds"),
    ]


def ordinal_agreement(pairs: DataFrame, first: str, second: str, scale: Sequence[str] = VERDICTS, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, compared, matching, within_one_step)`` of two labels on an ordered scale; other labels aren't compared."""
    order = F.array(*map(F.lit, scale))
    a, b = F.array_position(order, F.col(first)), F.array_position(order, F.col(second))
    both = pairs.withColumns({"_a": a, "_b": b}).where("_a > 0 and _b > 0")
    return both.groupBy(*by).agg(F.count("*").alias("compared"), F.count_if(F.col("_a") == F.col("_b")).alias("matching"), F.count_if(F.abs(F.col("_a") - F.col("_b")) <= 1).alias("within_one_step"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each group: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
