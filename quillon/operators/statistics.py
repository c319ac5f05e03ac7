"""Exact tests, agreement coefficients and resampling, over groups of any number."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES = 10_000
#: Resamples of one task, and numbers that are drawn at a time.
BLOCK, DRAWN = 1_000, 1 << 21


def sign_test(better: Column, worse: Column) -> Column:
    """Two-sided exact binomial p-value of wins against losses; 1 without any.  Terms are summed as logarithms' exponentials."""
    n, low = (better + worse).cast("double"), F.least(better, worse).cast("int")
    start = F.struct((-n * F.lit(math.log(2.0))).alias("term"), F.exp(-n * F.lit(math.log(2.0))).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.ln(n - i.cast("double") + 1.0) - F.ln(i.cast("double"))
        return F.struct(term.alias("term"), (state["sum"] + F.exp(term)).alias("sum"))

    tail = F.aggregate(F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


mcnemar = sign_test  # the exact test on discordant pairs is the same


def holm(df: DataFrame, p: str = "p", by: Sequence[str] = (), key: str = "name", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family; equal p-values are ordered by ``key``, which doesn't change them."""
    order = Window.partitionBy(*by).orderBy(p, key)
    size = F.count("*").over(Window.partitionBy(*by))
    scaled = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", scaled).withColumn(out, F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def cohen_kappa(pairs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, observed, expected, kappa)``; kappa is null where chance agreement is complete."""
    keys = list(by)
    both = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = both.groupBy(*keys, F.col(first).alias("_a"), F.col(second).alias("_b")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("_a").alias("_l")).agg(F.sum("c").alias("x"))
    right = cells.groupBy(*keys, F.col("_b").alias("_l")).agg(F.sum("c").alias("y"))
    chance = left.join(right, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = total.join(chance, keys, "left") if keys else total.crossJoin(chance)  # one row each without groups
    expected = F.coalesce("xy", F.lit(0)) / (F.col("n") * F.col("n"))
    observed = F.col("same") / F.col("n")
    return out.select(*keys, "n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.when(expected < 1, (observed - expected) / (1 - expected)), 6).alias("kappa"))


def krippendorff_alpha(labels: DataFrame, unit: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, units, values, alpha)`` for nominal labels over units with two or more; null with fewer than two different ones."""
    keys = list(by)
    per = labels.where(F.col(label).isNotNull()).groupBy(*keys, *unit, F.col(label).alias("_l")).agg(F.count("*").alias("c"))
    sizes = per.groupBy(*keys, *unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m >= 2")
    kept = per.join(sizes.select(*keys, *unit, "m"), [*keys, *unit])
    totals = kept.groupBy(*keys, "_l").agg(F.sum("c").alias("t")).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t")).alias("squares"))
    agree = sizes.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(F.col("same") / (F.col("m") - 1)).alias("diagonal"))
    out = agree.join(totals, keys) if keys else agree.crossJoin(totals)  # one row each without groups
    expected = F.col("n") * F.col("n") - F.col("squares")
    alpha = F.when(expected > 0, 1 - (F.col("n") - 1) * (F.col("n") - F.col("diagonal")) / expected)
    return out.select(*keys, "units", F.col("n").alias("values"), F.round(alpha, 6).alias("alpha"))


def paired_counts(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, mean_diff, better, worse, tied, sign_p)`` of two scores per question."""
    d = F.col(a) - F.col(b)
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("tied"))
    return out.withColumn("sign_p", F.round(sign_test(F.col("better"), F.col("worse")), 6))


def _blocks(values: DataFrame, by: str, resamples: int, columns: Sequence[str]) -> DataFrame:
    """Counted values once for each block of resamples; a block of one comparison is a task."""
    return values.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // BLOCK) - 1)))).select(by, "block", *columns)


def _means(values: np.ndarray, counts: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Sums of ``counts.sum()`` values drawn with replacement, ``draws`` times: how often each value is drawn is multinomial."""
    n, share = int(counts.sum()), counts / counts.sum()
    step = max(1, DRAWN // len(values))
    return np.concatenate([rng.multinomial(n, share, size=min(step, draws - lo)) @ values for lo in range(0, draws, step)])


def paired_bootstrap(pairs: DataFrame, a: str, b: str, by: str, order: str, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """``(by, n, mean_diff, ci_low, ci_high, significant)``: a percentile interval of the mean difference for each comparison.

    Equal differences are counted first, so a task holds the different ones; blocks of ``BLOCK`` resamples are tasks of their own.
    Draws depend on the seed and the block alone (``order`` is not needed for that).
    """
    kind = pairs.schema[by].dataType.simpleString()
    counted = pairs.select(by, (F.col(a) - F.col(b)).alias("d")).where("d is not null").groupBy(by, "d").agg(F.count("*").alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        block = int(g["block"].iat[0])
        draws = min(BLOCK, resamples - block * BLOCK)
        sums = _means(g["d"].to_numpy(), g["c"].to_numpy(), draws, np.random.default_rng((seed, block)))
        return pd.DataFrame({by: [g[by].iat[0]], "means": [sums / g["c"].sum()]})

    means = _blocks(counted, by, resamples, ["d", "c"]).groupBy(by, "block").applyInPandas(run, f"`{by}` {kind}, means array<double>")
    sorted_ = F.array_sort(F.flatten(F.collect_list("means")))
    ends = means.groupBy(by).agg(sorted_.alias("m")).select(by, F.get("m", int(0.025 * resamples)).alias("ci_low"), F.get("m", int(0.975 * resamples) - 1).alias("ci_high"))
    out = counted.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean_diff")).join(ends, by)
    return out.select(by, "n", "mean_diff", "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, by: str, null: float = 0.0, alternative: str = "two-sided", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Two-stage resampling, clusters and then their items: ``(by, n, clusters, estimate, low, high, p)``.

    A cluster drawn ``t`` times gives ``t`` times its items, each drawn anew.  Equal values of a cluster are counted first, and
    blocks of resamples are tasks of their own.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative!r}")
    kind = rows.schema[by].dataType.simpleString()
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(cluster).cast("string").alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["k", "v"])
        block = int(g["block"].iat[0])
        draws = min(BLOCK, resamples - block * BLOCK)
        rng = np.random.default_rng((seed, block))
        groups = [(x["v"].to_numpy(), x["c"].to_numpy()) for _, x in g.groupby("k")]
        times = rng.multinomial(len(groups), np.full(len(groups), 1 / len(groups)), size=draws)
        sums, sizes = np.zeros(draws), np.zeros(draws)
        for at, (v, c) in enumerate(groups):
            for t in np.unique(times[:, at]):
                mine = np.flatnonzero(times[:, at] == t)
                if t:
                    sums[mine] += _means(v, c * t, len(mine), rng)
                    sizes[mine] += t * c.sum()
        return pd.DataFrame({by: [g[by].iat[0]], "means": [sums / sizes]})

    means = _blocks(counted, by, resamples, ["k", "v", "c"]).groupBy(by, "block").applyInPandas(run, f"`{by}` {kind}, means array<double>")
    means = means.groupBy(by).agg(F.array_sort(F.flatten(F.collect_list("means"))).alias("m"))
    whole = counted.groupBy(by).agg(F.sum("c").alias("n"), F.countDistinct("k").alias("clusters"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("estimate"))
    out = whole.join(means, by)
    shift = F.col("estimate") - null
    far = {"two-sided": lambda m: F.abs(m - F.col("estimate")) >= F.abs(shift), "greater": lambda m: m - F.col("estimate") >= shift, "less": lambda m: m - F.col("estimate") <= shift}[alternative]

    def percentile(q: float) -> Column:
        at = q * (resamples - 1)
        low = int(at)
        a, b = F.get("m", low), F.get("m", min(low + 1, resamples - 1))
        return a + (b - a) * (at - low)

    return out.select(by, "n", "clusters", "estimate", percentile(0.025).alias("low"), percentile(0.975).alias("high"), ((1 + F.size(F.filter("m", far))) / (resamples + 1)).alias("p"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), summed in logarithms."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * (math.log1p(-p) if p < 1 else -math.inf if i < n else 0.0) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share, by bisection on the binomial tails."""
    alpha = (1 - level) / 2

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if k == 0 else solve(lambda p: binomial_tail(k, n, p) < alpha)
    upper = 1.0 if k == n else solve(lambda p: 1 - binomial_tail(k + 1, n, p) > alpha)
    return lower, upper


def share_test(rows: DataFrame, hits: str, total: str, p0: float = 0.5) -> DataFrame:
    """Adds ``share, p_greater, low, high``: an exact one-sided test of a share above ``p0`` and its interval."""

    @F.pandas_udf("p_greater double, low double, high double")
    def test(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = [(binomial_tail(int(a), int(b), p0), *clopper_pearson(int(a), int(b))) if b else (1.0, 0.0, 1.0) for a, b in zip(k, n)]
        return pd.DataFrame(out, columns=["p_greater", "low", "high"])

    return rows.withColumn("_t", test(F.col(hits), F.col(total))).select(*rows.columns, (F.col(hits) / F.col(total)).alias("share"), "_t.*")


def power_grid(grid: DataFrame, simulations: int = 20_000, seed: int = 0) -> DataFrame:
    """Adds ``power`` to ``(n, discordance, difference, alpha)``: how often an exact paired test finds a true difference."""
    names = grid.columns

    def run(batches):
        for b in batches:
            rng = np.random.default_rng(seed)
            power = []
            for n, disc, diff, alpha in zip(b["n"], b["discordance"], b["difference"], b["alpha"]):
                up, down = (disc + diff) / 2, (disc - diff) / 2
                draws = rng.multinomial(int(n), [max(0.0, up), max(0.0, down), max(0.0, 1 - disc)], size=simulations)
                pairs, times = np.unique(draws[:, :2], axis=0, return_counts=True)
                power.append(sum(int(t) for (x, y), t in zip(pairs, times) if _exact_p(int(x), int(y)) <= alpha) / simulations)
            yield b.assign(power=power)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema)
    return grid.select(*names).mapInPandas(run, f"{types}, power double")


def _exact_p(b: int, c: int) -> float:
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * binomial_tail(max(b, c), n, 0.5))
