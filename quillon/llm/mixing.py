"""Mixing sources to target weights by balanced sampling with the cube method.

The total is the largest at which every targeted source that has any text reaches its share within its cap of repeats; a
target of a source without text is shared out over the others in proportion.  (``policy="all"`` takes a given total instead,
lets sources at their cap fall short and gives the shortfall to the others.)

A source used ``f`` times on average has each text ``floor(f)`` times and with probability ``f - floor(f)`` once more.  Those
probabilities are moved through the null-space of two constraints, the tokens and the number of texts drawn, until they are 0
or 1.  The walk runs in blocks of bounded size; each leaves at most two undecided, which are walked again together, level by
level, until one block per source is left; its last two are rounded, and single texts are drawn or dropped to fill the gap.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from quillon.session import stored

#: Texts that are walked in one task at a time.
BLOCK = 4_000
MAX_TARGETS = 10_000


def flight(tokens: list[int], p: list[float], seed: int, land: bool = False) -> list[float]:
    """Probabilities after the walk: 0 or 1 but for at most two, or for none with ``land``; tokens and count expected are kept."""
    rng = random.Random(seed)
    x = list(p)
    active: list[int] = []
    for i, v in enumerate(x):
        if v < 1e-9 or v > 1 - 1e-9:
            x[i] = float(round(v))
            continue
        active.append(i)
        while len(active) == 3:
            _step(x, tokens, active, rng)
    while len(active) == 2 and tokens[active[0]] == tokens[active[1]]:
        _step(x, tokens, active, rng)
    if land and active:
        want = sum(x[i] * tokens[i] for i in active)
        choices = [[0.0], [1.0]] if len(active) == 1 else [[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)]
        count = sum(x[i] for i in active)
        best = min(choices, key=lambda c: (abs(sum(v * tokens[i] for v, i in zip(c, active)) - want), abs(sum(c) - count)))
        for v, i in zip(best, active):
            x[i] = v
    if land:
        _balance(x, tokens, sum(v * t for v, t in zip(p, tokens)) - sum(v * t for v, t in zip(x, tokens)))
    return x


def _balance(x: list[float], tokens: list[int], short: float) -> None:
    """After landing, draw or drop the text whose tokens come closest to what is missing, as long as that brings it closer.

    A single text of a skewed source can hold more tokens than all the others drawn; rounding it leaves such a gap.
    """
    for _ in range(64):
        pool = [i for i, v in enumerate(x) if v == (0.0 if short > 0 else 1.0) and tokens[i] > 0]
        if not pool:
            return
        i = min(pool, key=lambda k: (abs(abs(short) - tokens[k]), k))
        if abs(abs(short) - tokens[i]) >= abs(short):
            return
        short += -tokens[i] if short > 0 else tokens[i]
        x[i] = 1.0 - x[i]


def _step(x: list[float], t: list[int], active: list[int], rng: random.Random) -> None:
    """One move along a direction that keeps the tokens and the count, to where a probability becomes 0 or 1."""
    if len(active) == 3:
        a, b, c = active
        u = [t[b] - t[c], t[c] - t[a], t[a] - t[b]]
        if not any(u):
            u = [1, -1, 0]
    else:
        u = [1, -1]
    up = down = float("inf")
    for i, d in zip(active, u):
        if d > 0:
            up, down = min(up, (1 - x[i]) / d), min(down, x[i] / d)
        elif d < 0:
            up, down = min(up, x[i] / -d), min(down, (1 - x[i]) / -d)
    move = up if rng.random() * (up + down) < down else -down
    for i, d in zip(active, u):
        x[i] += move * d
    done = [i for i in active if x[i] < 1e-9 or x[i] > 1 - 1e-9]
    for i in done:
        x[i] = float(round(x[i]))
        active.remove(i)


def plan_uses(totals: dict[str, int], targets: dict[str, tuple[float, int]], policy: str = "exact", total: int | None = None) -> dict[str, float]:
    """How often each source's text is used on average: ``totals`` are tokens, ``targets`` (share, most repeats)."""
    live = {s: (share, cap) for s, (share, cap) in targets.items() if totals.get(s, 0) > 0 and share > 0 and cap > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    if policy == "exact":
        size = min(cap * totals[s] * whole / share for s, (share, cap) in live.items())
        if total is not None:
            size = min(size, total)
        return {s: min(float(cap), share / whole * size / totals[s]) for s, (share, cap) in live.items()}
    size = sum(totals[s] for s in live) if total is None else total
    uses: dict[str, float] = {}
    open_ = dict(live)
    while open_:
        rest = size - sum(uses[s] * totals[s] for s in uses)
        weight = sum(share for share, _ in open_.values())
        over = [s for s, (share, cap) in open_.items() if share / weight * rest >= cap * totals[s]]
        if not over:
            return uses | {s: max(0.0, share / weight * rest / totals[s]) for s, (share, _) in open_.items()}
        for s in over:
            uses[s] = float(open_.pop(s)[1])
    return uses


def mix_sources(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", policy: str = "exact", total: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """``mix(id, source, n_tokens, repeats)`` with the texts used, and ``shares``: one row per target and per source of the table.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats`` (null: 1) for at most ``MAX_TARGETS`` sources.  Texts
    of null or untargeted sources are unused; empty texts are used but weigh nothing.  Ids are taken as they come: a repeated
    row is a text of its own.  The same input gives the same mix, whatever the partitioning.
    """
    spark = df.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    aims = {r["source"]: (max(0.0, float(r["target_share"] or 0)), int(1 if r["max_repeats"] is None else r["max_repeats"])) for r in rows}
    sized = stored(with_token_counts(df, [id_col, source_col], text_col, vocabulary).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "n_tokens"))
    stats = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    own = {r["source"]: (r["docs"], r["tokens"]) for r in stats.where(F.col("source").isin(list(aims))).collect()} if aims else {}
    uses = plan_uses({s: t for s, (_, t) in own.items()}, aims, policy, total)
    used = [(s, int(f + 1e-9), max(0.0, f - int(f + 1e-9)), max(1, -(-own[s][0] // BLOCK))) for s, f in uses.items()]
    per = spark.createDataFrame(used, "source string, base int, p double, blocks int")  # a row per target
    chosen = sized.join(F.broadcast(per), "source")
    state = chosen.select("id", "source", "n_tokens", "base", "p", F.pmod(F.xxhash64("id", "n_tokens"), F.col("blocks")).cast("int").alias("block"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, source string, n_tokens long, base int, p double, block int"
    sure = state.where("p < 1e-9")
    walk = state.where("p >= 1e-9")
    decided = [sure]
    most = max((b for *_, b in used), default=1)
    while True:
        last = most == 1
        moved = stored(walk.groupBy("source", "block").applyInPandas(_walker(seed, last), schema))
        decided.append(moved.where("p = 0 or p = 1"))
        if last:
            break
        # at most two of each block are left
        most = -(-2 * most // BLOCK)
        walk = moved.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("block", "id"), F.lit(most)).cast("int"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    mix = stored(out.select("id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats")).where("repeats > 0"))
    reached = mix.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum("repeats").alias("copies"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    whole = reached.agg(F.sum("used_tokens").alias("whole"))
    aim = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    shares = stats.join(aim, "source", "full").join(reached, "source", "left").crossJoin(whole)  # one row
    zero = F.lit(0)
    shares = shares.select(
        "source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("used_docs", zero).alias("used_docs"),
        F.coalesce("copies", zero).alias("copies"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce("most_repeats", zero).alias("most_repeats"),
        F.round(F.when(F.col("whole") > 0, F.coalesce("used_tokens", zero) / F.col("whole")), 6).alias("reached_share"),
    )
    return mix.withColumnRenamed("id", id_col), shares


def _walker(seed: int, land: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["id", "n_tokens"], kind="stable").reset_index(drop=True)
        first = f"{seed}|{block['source'].iat[0]}|{block['id'].iat[0]}"
        order = list(range(len(block)))
        random.Random(first).shuffle(order)
        tokens, p = block["n_tokens"].tolist(), block["p"].tolist()
        x = flight([tokens[i] for i in order], [p[i] for i in order], seed, land)
        moved = [0.0] * len(order)
        for i, v in zip(order, x):
            moved[i] = v
        block["p"] = moved
        return block

    return run
