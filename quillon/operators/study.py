"""Tables of a study: graded claims folded into sentences, pairings of conditions, and comparisons of graders and judges."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import model_size
from quillon.operators import statistics

CLAIM_LABELS = ("supported", "unsupported", "contradicted", "not a claim")
SEVERITY = {"supported": 0, "unsupported": 1, "contradicted": 2}


def severity(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), label)


def fold_claims(claims: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """One label per sentence: its worst real one; ``not a claim`` only where nothing else was given."""
    worst = F.max_by(F.when(F.col(label) != "not a claim", F.col(label)), severity(F.col(label)))
    return claims.where(F.col(label).isin(*CLAIM_LABELS)).groupBy(*keys).agg(F.coalesce(worst, F.lit("not a claim")).alias("label"))


def faithful_answers(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, claims, faithful)``: whether every real claim of an answer is supported; answers without claims give no row."""
    real = folded.where("label <> 'not a claim'")
    return real.groupBy(*keys).agg(F.count("*").alias("claims"), F.bool_and(F.col("label") == "supported").alias("faithful"))


def paired(table: DataFrame, keys: Sequence[str], by: str, first: str, second: str, outcome: str, order: str) -> DataFrame:
    """One row per key with the outcome under both conditions; rows that miss one are dropped.

    Of repeated rows the first by ``order`` counts.
    """
    value = F.min_by(F.when(F.col(outcome).isNotNull(), F.col(outcome)), F.when(F.col(outcome).isNotNull(), F.col(order)))
    wide = table.groupBy(*keys).pivot(by, [first, second]).agg(value)
    return wide.dropna(subset=[first, second])


def condition_summary(table: DataFrame, by: Sequence[str], means: Sequence[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.count("*").alias("answers"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(f"mean_{m}") for m in means])


def discordant(pairs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, mean_first, mean_second, gained, lost, p)`` of paired yes/no outcomes with the exact test on discordant pairs."""
    from quillon.operators.statistics import mcnemar

    a, b = F.col(first).cast("int"), F.col(second).cast("int")
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(a), 6).alias("mean_first"), F.round(F.avg(b), 6).alias("mean_second"),
        F.count_if((a == 0) & (b == 1)).alias("gained"), F.count_if((a == 1) & (b == 0)).alias("lost"),
    )
    return out.withColumn("p", F.round(mcnemar(F.col("gained"), F.col("lost")), 6))


def sets_of(table: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """A row for each subset that a row belongs to (``subset``); a row may be in several or none."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()]))
    return table.withColumn("subset", F.explode(names))


def without_failed(table: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Rows of which no row with the same keys failed."""
    return table.join(table.where(F.col(error).isNotNull()).select(*keys).distinct(), list(keys), "left_anti")


def intention_to_treat(graded: DataFrame, failed: DataFrame) -> DataFrame:
    """Graded rows together with the failed ones, whose missing outcomes stay null until they are counted as not reached."""
    return graded.unionByName(failed, allowMissingColumns=True)


def experiment_jobs(models: DataFrame, repos: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every model, repository and condition that allows the model; three small tables (``conditions.models`` null: all)."""
    allowed = F.col("models").isNull() | F.array_contains("models", F.col("model"))
    return conditions.crossJoin(models).where(allowed).crossJoin(repos).select("model", "repo", "prompt", "context")


def kappa_bootstrap(pairs: DataFrame, unit: str, first: str, second: str, by: str, null: float = 0.0, alternative: str = "less", resamples: int = statistics.RESAMPLES, seed: int = 0) -> DataFrame:
    """``(by, n, units, estimate, low, high, p)``: kappa of two labels with an interval from resampled units, such as whole answers.

    Units with the same counts of label pairs are one kind; how often each kind is drawn is multinomial.  Estimate and interval
    are null where chance agreement is complete.
    """
    labels = sorted(r["l"] for r in pairs.select(F.explode(F.array(first, second)).alias("l")).distinct().collect())  # a scale's labels
    cells = [(a, b) for a in labels for b in labels]
    kinds = pairs.groupBy(by, unit).agg(F.array(*[F.count_if((F.col(first) == a) & (F.col(second) == b)).cast("double") for a, b in cells]).alias("table")).groupBy(by, "table").agg(F.count("*").alias("c"))

    def kappa(tables):
        import numpy as np

        t = tables.reshape(-1, len(labels), len(labels))
        n = t.sum((1, 2))
        seen = np.einsum("xkk->x", t) / n
        chance = (t.sum(1) * t.sum(2)).sum(1) / n**2
        return np.where(chance < 1, (seen - chance) / np.where(chance < 1, 1 - chance, 1), np.nan)

    def run(g):
        import numpy as np
        import pandas as pd

        tables, c = np.stack(g["table"].to_numpy()), g["c"].to_numpy()
        estimate = float(kappa((tables * c[:, None]).sum(0)[None])[0])
        drawn = np.random.default_rng(seed).multinomial(int(c.sum()), c / c.sum(), size=resamples)
        boot = kappa(drawn @ tables)
        boot = boot[~np.isnan(boot)]
        shift = boot - estimate
        far = {"two-sided": np.abs(shift) >= abs(estimate - null), "greater": shift >= estimate - null, "less": shift <= estimate - null}[alternative]
        low, high = np.percentile(boot, [2.5, 97.5]) if len(boot) else (np.nan, np.nan)
        return pd.DataFrame([(g[by].iat[0], int((tables * c[:, None]).sum()), int(c.sum()), estimate, low, high, (1 + far.sum()) / (len(boot) + 1))], columns=["by", "n", "units", "estimate", "low", "high", "p"])

    kind = pairs.schema[by].dataType.simpleString()
    return kinds.groupBy(by).applyInPandas(run, f"by {kind}, n long, units long, estimate double, low double, high double, p double").withColumnRenamed("by", by)


QUESTION = ["model", "repo", "question_id"]


def primary_comparisons(answers: DataFrame, grades: DataFrame, claims: DataFrame, judges: DataFrame, margin: float = -0.1, drop_failed: bool = False, resamples: int = statistics.RESAMPLES, seed: int = 0) -> DataFrame:
    """The planned comparisons of a study, ``(id, n, estimate, low, high, p, p_holm)``.

    C1 grounded answers, P1 against P0, each question's mean over models; C2 fully correct answers of the 7B models, non-inferior
    within ``margin``; C3a citation precision and C3b correctness, P3 against P1; C4 each judge's claim labels against the main
    grader's; C5 the share of wrong P1 answers whose claims are all supported.  Intervals come from resampled repositories and
    questions (C4: answers).  A failed answer counts as not reached, or with ``drop_failed`` its question is left out.

    ``answers`` has ``results_file, model, repo, prompt, context, question_id, failed, grounded, precision``; ``grades`` has ``code,
    results_file, question_id, grader, correctness``; ``claims`` has ``code, results_file, question_id, claim, grader, label`` and
    ``judges`` has ``judge, results_file, question_id, claim, label``.
    """
    boot = lambda rows, name, **k: statistics.cluster_bootstrap(rows.withColumn("id", F.lit(name)), "d", "repo", "id", resamples=resamples, seed=seed, **k).select("id", "n", "estimate", "low", "high", "p")
    gain = lambda rows, a, b: rows.withColumn("d", F.col(b).cast("double") - F.col(a).cast("double"))
    frozen = answers.where("context = 'frozen'")
    if drop_failed:
        frozen = frozen.join(frozen.where("failed").select(*QUESTION).distinct(), QUESTION, "left_anti")
    frozen = frozen.withColumn("grounded", (F.col("grounded") & ~F.col("failed")).cast("int"))
    one = gain(paired(frozen, QUESTION, "prompt", "P0", "P1", "grounded", "results_file"), "P0", "P1").groupBy("repo", "question_id").agg(F.avg("d").alias("d"))
    parts = [boot(one, "C1")]

    main = grades.where("grader = 'main'").join(answers, ["results_file", "question_id"]).withColumn("correct", (F.lower("correctness") == "correct").cast("int"))
    if not drop_failed:
        lost = answers.where("failed").join(main.select("question_id").distinct(), "question_id", "left_semi").withColumn("correct", F.lit(0))
        main = intention_to_treat(main, lost)
    seven = main.where((model_size(F.col("model")) == 7) & (F.col("context") == "frozen"))
    parts.append(boot(gain(paired(seven, QUESTION, "prompt", "P0", "P1", "correct", "results_file"), "P0", "P1"), "C2", null=margin, alternative="greater"))
    third = seven.where("prompt = 'P3'").select("question_id").distinct()
    precise = frozen.where(model_size(F.col("model")) == 7).join(third, "question_id", "left_semi")
    parts.append(boot(gain(paired(precise, QUESTION, "prompt", "P1", "P3", "precision", "results_file"), "P1", "P3"), "C3a"))
    graded = paired(seven, QUESTION, "prompt", "P1", "P3", "correct", "results_file")
    exact = discordant(graded, "P1", "P3").select(F.lit("C3b").alias("id"), F.col("p").alias("exact"))
    parts.append(boot(gain(graded, "P1", "P3"), "C3b").join(exact, "id").select("id", "n", "estimate", "low", "high", F.col("exact").alias("p")))

    human = claims.where("grader = 'main' and label <> 'not a claim'")
    both = human.select("code", "results_file", "question_id", "claim", F.col("label").alias("human")).join(judges, ["results_file", "question_id", "claim"])
    for small, null in ((True, 0.4), (False, 0.7)):
        mine = both.where(F.coalesce(model_size(F.col("judge")) <= 4, F.lit(False)) == small)
        parts.append(kappa_bootstrap(mine, "code", "human", "label", "judge", null, "less", resamples, seed).select(F.concat(F.lit("C4 "), "judge").alias("id"), "n", "estimate", "low", "high", "p"))

    wrong = seven.where("prompt = 'P1' and correct = 0 and code is not null").select("code").distinct()
    faithful = human.groupBy("code").agg(F.bool_and(F.col("label") == "supported").alias("faithful")).join(wrong, "code").agg(F.count_if("faithful").alias("k"), F.count("*").alias("n")).where("n > 0")
    share = statistics.share_test(faithful, "k", "n")
    parts.append(share.select(F.lit("C5").alias("id"), F.col("n").cast("long").alias("n"), F.col("share").alias("estimate"), "low", "high", F.col("p_greater").alias("p")))
    return statistics.holm(reduce(DataFrame.unionByName, parts), key="id")
