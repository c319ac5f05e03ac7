"""Consensus labels from several annotators: triplet moments for the annotators, log-odds votes for the items.

Model: annotator ``i`` knows the true class of an item with probability ``s_i`` and otherwise draws a label from a habit
``q_i`` of its own.  For two annotators the agreement in excess of what their own label frequencies give by chance is

    agree_ij - sum_k m_i(k) m_j(k) = s_i s_j (1 - sum_k prior_k^2)

so the corrected agreements ``c_ij`` are ``s_i s_j``, and a triplet of annotators solves each of them:
``s_i^2 = c_ij c_ik / c_jk``.  Triplets are pooled, each weighted by the geometric mean of the items behind its three pairs, so
the sums over all triplets are matrix products.  A vote for label ``l``
then weighs ``log(s_i [l = k] + (1 - s_i) q_i(l))`` for class ``k``; the prior is added and the largest sum wins.

Annotators who swap or shift classes break the model's symmetry: their errors carry information too.  So the log-odds are
refined: the triplet consensus gives each annotator's votes by class, these give class-wise log-odds, and so on for
``REFINEMENTS`` rounds; only these ``annotators x classes x classes`` sums go to the driver.

Up to ``DENSE`` annotators the table of their pairs is one matrix, counted by products of indicator matrices within tasks and
solved on the driver.  With more of them pairs are counted by a join of the votes of an item, and the sums over triplets by a
join of pairs; only one row per annotator goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import stored

#: Annotators whose pairs are held as a matrix (8 bytes each, DENSE squared); the pairs of more are joined.
DENSE = 2_048
REFINEMENTS = 12
#: Items whose indicator matrices are multiplied at a time.
BLOCK = 1_024


def clean_label(label: Column, classes: Sequence[str]) -> Column:
    """The class a free-hand label names, apart from case, outer blanks and the separators between words; else null."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[\s\u00a0_\-./]+", " ")
    known = F.create_map(*[F.lit(x) for c in classes for x in (c.replace("_", " "), c)])
    return F.element_at(known, plain)


def usable_votes(df: DataFrame, item: Sequence[str], annotator: str, label: str, time: str, row_id: str, classes: Sequence[str]) -> DataFrame:
    """One row per item and annotator: the latest usable label.  Rows with a null item, annotator or label are left out."""
    keys = [F.col(c).alias(f"_{c}") for c in item]
    rows = df.select(*keys, F.col(annotator).alias("_who"), clean_label(F.col(label), classes).alias("_label"), F.struct(F.col(time).alias("t"), F.col(row_id).alias("r")).alias("_at"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*(f"_{c}" for c in item), "_who", "_label"]))
    # equal times and ids leave the greatest label, so a result never depends on the order of rows
    latest = rows.groupBy(*(f"_{c}" for c in item), "_who").agg(F.max(F.struct("_at", "_label")).alias("_last"))
    return latest.select(*[F.col(f"_{c}").alias(c) for c in item], F.col("_who").alias("annotator"), F.col("_last._label").alias("label"))


@dataclass
class Annotators:
    names: list[str]
    skill: np.ndarray  # s_i
    habit: np.ndarray  # q_i(k)
    prior: np.ndarray
    votes: np.ndarray
    together: np.ndarray | None = None  # pairs of votes that each takes part in
    agree: np.ndarray | None = None  # and how many of them agree
    refined: np.ndarray | None = None  # [annotator, class, label] probabilities from the consensus

    @property
    def accuracy(self) -> np.ndarray:
        if self.refined is not None:
            return (np.einsum("akk->ak", self.refined) * self.prior).sum(1)
        return self.skill + (1 - self.skill) * (self.habit * self.prior).sum(1)

    def weights(self) -> np.ndarray:
        """[annotator, label, class] log-odds."""
        if self.refined is not None:
            return np.log(self.refined.transpose(0, 2, 1))
        k = len(self.prior)
        chance = (1 - self.skill)[:, None, None] * self.habit[:, :, None]
        return np.log(np.maximum(chance + self.skill[:, None, None] * np.eye(k)[None], 1e-6))


def triplet_sums(together: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """``[annotator, 3]``: over all triplets the weighted sums of ``e_ij e_ik`` and of ``e_jk``, and over pairs that of ``e_ij``."""
    w = np.sqrt(together.astype(float))
    np.fill_diagonal(w, 0)
    we = w * excess
    return np.stack([((we @ w) * we).sum(1), ((w @ we) * w).sum(1), (w * we).sum(1)], 1)


def joined_triplet_sums(pairs: DataFrame) -> DataFrame:
    """``(i, top, bottom, alone)``, the same sums from ``pairs(i, j, n, e)``, which holds each pair both ways, by joins of pairs."""
    p = pairs.select("i", "j", F.sqrt("n").alias("w"), "e")
    ij = p.select("i", "j", F.col("w").alias("w1"), F.col("e").alias("e1"))
    jk = p.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("w").alias("w2"), F.col("e").alias("e2"))
    ik = p.select("i", F.col("j").alias("k"), F.col("w").alias("w3"), F.col("e").alias("e3"))
    w = F.col("w1") * F.col("w2") * F.col("w3")
    three = ij.join(jk, "j").join(ik, ["i", "k"]).groupBy("i").agg(F.sum(w * F.col("e1") * F.col("e3")).alias("top"), F.sum(w * F.col("e2")).alias("bottom"))
    one = p.groupBy("i").agg(F.sum(F.col("w") * F.col("w") * F.col("e")).alias("alone"))
    return one.join(three, "i", "left").select("i", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("bottom", F.lit(0.0)).alias("bottom"), "alone")


def solve_triplets(sums: np.ndarray, marginal: np.ndarray, names: list[str], pairs: np.ndarray, rounds: int = 12) -> Annotators:
    """Annotators from their triplet sums, their label counts and the pairs of votes that each takes part in."""
    votes = marginal.sum(1)
    freq = (marginal + 1e-9) / np.maximum(votes, 1e-9)[:, None]
    prior = marginal.sum(0) / max(marginal.sum(), 1)
    top, bottom, alone = sums.T
    skill = np.full(len(names), 0.6)
    for _ in range(rounds):
        room = max(1e-9, 1 - (prior**2).sum())
        found = np.sqrt(np.clip(top / np.where(bottom > 0, bottom, 1) / room, 1e-4, 0.995**2))
        skill = np.where(bottom > 0, np.where(alone < 0, 0.01, found), skill)
        # annotators with no triplet, and the noise of rare ones: shrink towards the pooled skill
        pooled = (skill * votes).sum() / max(votes.sum(), 1)
        skill = np.clip((skill * pairs + pooled * 10) / (pairs + 10), 0.01, 0.99)
        new = (votes[:, None] * skill[:, None] * freq).sum(0)  # those who know more tell more about the classes
        new /= max(new.sum(), 1e-9)
        if np.abs(new - prior).max() < 1e-6:
            break
        prior = new
    habit = np.maximum((freq - skill[:, None] * prior[None]) / (1 - skill)[:, None], 0)
    habit = habit + 0.02
    habit /= habit.sum(1, keepdims=True)
    return Annotators(names, skill, habit, prior, votes)


def _count_pairs(several: DataFrame, at: dict[str, int], of: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the items that two annotators labelled, and labelled alike."""
    size = len(at)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together, agree = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                row, who, said = _flat(b["votes"].iloc[lo : lo + BLOCK], at, of)
                ones = np.zeros((len(of), int(row.max()) + 1, size), np.float32)
                ones[said, row, who] = 1
                for one in ones:
                    agree += one.T @ one
                every = ones.sum(0)
                together += every.T @ every
        a, b = np.nonzero(np.triu(together, 1))
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "n": together[a, b].astype(np.int64), "same": agree[a, b].astype(np.int64)})

    got = several.select("votes").mapInPandas(count, "a int, b int, n long, same long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).toPandas()
    together, agree = np.zeros((size, size)), np.zeros((size, size))
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    together[a, b] = together[b, a] = got["n"]
    agree[a, b] = agree[b, a] = got["same"]
    return together, agree


def _join_pairs(votes: DataFrame, item: Sequence[str], freq: DataFrame) -> DataFrame:
    """``(i, j, n, same, e)`` of all pairs, both ways; ``freq(annotator, shares)`` has each one's share of every label."""
    x = votes.select(*item, F.col("annotator").alias("i"), F.col("label").alias("x"))
    y = votes.select(*item, F.col("annotator").alias("j"), F.col("label").alias("y"))
    pairs = x.join(y, list(item)).where("i <> j").groupBy("i", "j").agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("same"))
    both = pairs.join(freq.select(F.col("annotator").alias("i"), F.col("shares").alias("p")), "i").join(freq.select(F.col("annotator").alias("j"), F.col("shares").alias("q")), "j")
    chance = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.select("i", "j", "n", "same", (F.col("same") / F.col("n") - chance).alias("e"))


def fit(votes: DataFrame, item: Sequence[str], classes: Sequence[str], refinements: int = REFINEMENTS, dense: int = DENSE) -> tuple[Annotators, DataFrame]:
    """The annotators, and the votes gathered by item: ``(*item, votes array)``; an item has at most one vote of each annotator."""
    gathered = stored(votes.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct("annotator", "label"))).alias("votes")))
    flat = gathered.select(*item, F.explode("votes").alias("v")).select(*item, "v.annotator", "v.label")
    wide = flat.groupBy("annotator").agg(*[F.count_if(F.col("label") == c).cast("double").alias(f"n{k}") for k, c in enumerate(classes)])
    counts = wide.orderBy("annotator").toPandas()  # a row per annotator
    names = counts["annotator"].tolist()
    at, of = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(classes)}
    marginal = counts[[f"n{k}" for k in range(len(classes))]].to_numpy(float)
    several = stored(gathered.where(F.size("votes") > 1).select("votes")) if len(names) else gathered.select("votes")
    if len(names) <= dense:
        together, agree = _count_pairs(several, at, of)
        freq = (marginal + 1e-9) / np.maximum(marginal.sum(1), 1e-9)[:, None]
        sums = triplet_sums(together, np.divide(agree, together, out=np.zeros_like(agree), where=together > 0) - freq @ freq.T)
        pairs, alike = together.sum(1), agree.sum(1)
    else:
        total = sum((F.col(f"n{k}") for k in range(len(classes))), F.lit(0.0))
        shares = wide.select("annotator", F.array(*[(F.col(f"n{k}") + 1e-9) / total for k in range(len(classes))]).alias("shares"))
        joined = stored(_join_pairs(flat, item, shares))
        rows = joined_triplet_sums(joined).join(joined.groupBy("i").agg(F.sum("n").alias("pairs"), F.sum("same").alias("alike")), "i").toPandas().set_index("i")
        rows = rows.reindex(names).fillna(0.0)
        sums, pairs, alike = rows[["top", "bottom", "alone"]].to_numpy(float), rows["pairs"].to_numpy(float), rows["alike"].to_numpy(float)
    model = solve_triplets(sums, marginal, names, pairs)
    model.together, model.agree = pairs, alike
    for _ in range(refinements if len(names) else 0):
        before = model.refined
        _refine(model, several, at, of)
        if before is not None and np.abs(model.refined - before).max() < 1e-3:
            break
    return model, gathered


def _flat(votes: pd.Series, at: dict[str, int], of: dict[str, int]) -> tuple[np.ndarray, ...]:
    """The votes of many items in a row: item, annotator, label."""
    row = np.repeat(np.arange(len(votes)), votes.str.len().to_numpy().astype(np.int64))
    who = np.array([at[v["annotator"]] for vs in votes for v in vs], dtype=np.int64)
    said = np.array([of[v["label"]] for vs in votes for v in vs], dtype=np.int64)
    return row, who, said


def _posterior(votes: pd.Series, at: dict[str, int], of: dict[str, int], weights: np.ndarray, log_prior: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log scores by item and class, and the votes flat: item, annotator, label."""
    row, who, said = _flat(votes, at, of)
    score = np.tile(log_prior, (len(votes), 1))
    np.add.at(score, row, weights[who, said])
    return score, row, who, said


def _refine(model: Annotators, gathered: DataFrame, at: dict[str, int], of: dict[str, int]) -> None:
    weights, log_prior, shape = model.weights(), np.log(np.maximum(model.prior, 1e-9)), (len(at), len(of), len(of))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, prior = np.zeros(shape), np.zeros(len(of))
        for b in batches:
            score, row, who, said = _posterior(b["votes"], at, of, weights, log_prior)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            prior += p.sum(0)
            for label in range(len(of)):
                mine = said == label
                np.add.at(total[:, :, label], who[mine], p[row[mine]])
        flat = np.concatenate([total.ravel(), prior])
        yield pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

    sums = np.zeros(int(np.prod(shape)) + len(of))
    got = gathered.mapInPandas(tally, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    sums[got["i"].to_numpy()] = got["v"].to_numpy()
    confusion = sums[: -len(of)].reshape(shape) + 0.3
    model.refined = confusion / confusion.sum(2, keepdims=True)
    model.prior = (sums[-len(of) :] + 1e-6) / (sums[-len(of) :] + 1e-6).sum()


def consensus(votes: DataFrame, item: Sequence[str], classes: Sequence[str], least_votes: int = 2, refinements: int = REFINEMENTS) -> DataFrame:
    """``(*item, label, confidence, n_votes, agreement)`` for items with ``least_votes`` annotators or more.

    ``agreement`` is the share of agreeing pairs of votes.  Ties go to the class listed first.  No votes, no rows.
    ``refinements=0`` gives the labels of the triplet solution itself.
    """
    model, gathered = fit(votes, item, classes, refinements)
    weights, log_prior = model.weights(), np.log(np.maximum(model.prior, 1e-9))
    at, of = {x: i for i, x in enumerate(model.names)}, {x: i for i, x in enumerate(classes)}

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["votes"].str.len().to_numpy().astype(np.int64)
            score, row, _, said = _posterior(b["votes"], at, of, weights, log_prior)
            tally = np.zeros((len(b), len(classes)))
            np.add.at(tally, (row, said), 1)
            best = score.argmax(1)
            odds = np.exp(score - score.max(1, keepdims=True))
            out = b[list(item)].copy()
            out["label"] = np.array(classes, dtype=object)[best]
            out["confidence"] = np.round(odds.max(1) / odds.sum(1), 6)
            out["n_votes"] = n
            out["agreement"] = np.round((tally * (tally - 1)).sum(1) / np.maximum(n * (n - 1), 1), 6)
            yield out

    kept = gathered.where(F.size("votes") >= least_votes)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in item)
    return kept.mapInPandas(decide, f"{types}, label string, confidence double, n_votes int, agreement double")


def reliability(votes: DataFrame, item: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """One row per annotator: ``(annotator, votes, paired_votes, observed_agreement, skill, accuracy)``; skill 0 is a guesser."""
    model, _ = fit(votes, item, classes)
    pairs = model.together
    rows = [
        (name, int(model.votes[i]), int(pairs[i]), round(float(model.agree[i] / pairs[i]), 6) if pairs[i] else None, round(float(model.skill[i]), 6), round(float(model.accuracy[i]), 6))
        for i, name in enumerate(model.names)
    ]
    return votes.sparkSession.createDataFrame(rows, "annotator string, votes long, paired_votes long, observed_agreement double, skill double, accuracy double")


def overall_agreement(votes: DataFrame, item: Sequence[str]) -> DataFrame:
    """One row: ``(items, pairable_votes, observed, expected, alpha)``, Krippendorff's nominal alpha over items with two votes or more.

    Vote counts per item and label give everything, so no pairs are formed.  ``alpha`` is null without two different labels.
    """
    per = votes.groupBy(*item, "label").agg(F.count("*").alias("c"))
    per_item = per.groupBy(*item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("labels"))
    per_item = per_item.where("m >= 2")
    totals = per_item.select("m", F.explode("labels").alias("label", "c")).groupBy("label").agg(F.sum("c").alias("n"))
    all_of = totals.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("alike"))
    seen = per_item.agg(F.count("*").alias("items"), F.sum("m").alias("pairable_votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same"))
    observed, expected = F.col("same") / F.col("pairable_votes"), F.col("alike") / (F.col("n") * (F.col("n") - 1))
    both = seen.crossJoin(all_of)  # one row each
    return both.select("items", "pairable_votes", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(F.when(expected < 1, 1 - (1 - observed) / (1 - expected)), 6).alias("alpha"))
