import numpy as np
from pyspark.sql import functions as F

from quillon.llm import consensus as c

CLASSES = ("supported", "unsupported", "contradicted", "not a claim")
SCHEMA = "answer string, claim int, grader string, support string, t timestamp, r long"


def simulated(items=700, seed=5):
    rng = np.random.default_rng(seed)
    prior = [0.55, 0.25, 0.12, 0.08]
    truth = rng.choice(4, items, p=prior)
    skill = {**{f"g{i}": s for i, s in enumerate([0.95, 0.9, 0.85, 0.8, 0.7, 0.5])}, "lazy": None, "random": 0.0, "swap": -1}
    rows = []
    for i in range(items):
        for g in rng.choice(list(skill), rng.integers(2, 7), replace=False):
            y = truth[i]
            if skill[g] is None:
                label = 0
            elif skill[g] == -1:
                label = {0: 1, 1: 0}.get(y, y) if rng.random() < 0.85 else rng.integers(4)
            else:
                label = y if rng.random() < skill[g] else rng.integers(4)
            rows.append((f"A{i}", 1, str(g), CLASSES[label]))
    return truth, rows


def test_consensus_beats_the_majority_and_ranks_annotators(spark):
    truth, rows = simulated()
    votes = spark.createDataFrame(rows, "answer string, claim int, annotator string, label string")
    out = {r["answer"]: r for r in c.consensus(votes, ["answer", "claim"], CLASSES).collect()}
    right = np.mean([out[f"A{i}"]["label"] == CLASSES[y] for i, y in enumerate(truth)])
    tally = {}
    for a, _, _, label in rows:
        tally.setdefault(a, []).append(label)
    majority = np.mean([max(CLASSES, key=tally[f"A{i}"].count) == CLASSES[y] for i, y in enumerate(truth)])
    assert right > majority + 0.03 and right > 0.85
    plain = {r["answer"]: r["label"] for r in c.consensus(votes, ["answer", "claim"], CLASSES, refinements=0).collect()}
    assert majority < np.mean([plain[f"A{i}"] == CLASSES[y] for i, y in enumerate(truth)]) <= right + 0.01  # triplets alone
    rows = {r["annotator"]: r for r in c.reliability(votes, ["answer", "claim"], CLASSES).collect()}
    accuracy = {k: r["accuracy"] for k, r in rows.items()}
    assert accuracy["g0"] > accuracy["g4"] > accuracy["g5"] > max(accuracy["random"], accuracy["swap"])
    assert min(rows[f"g{i}"]["skill"] for i in range(4)) > 0.6 > 0.3 > max(rows["lazy"]["skill"], rows["random"]["skill"])
    assert all(0 < r["confidence"] <= 1 and 0 <= r["agreement"] <= 1 for r in out.values())


def test_triplets_recover_skills_from_exact_moments():
    s, prior = np.array([0.9, 0.7, 0.5, 0.3]), np.array([0.6, 0.4])
    agree = np.outer(s, s) * (1 - (prior**2).sum()) + (prior**2).sum()
    n = np.full((4, 4), 1e6)
    np.fill_diagonal(n, 0)
    sums = c.triplet_sums(n, agree - (prior**2).sum() * (1 - np.eye(4)))
    found = c.solve_triplets(sums, np.tile(prior * 1e6, (4, 1)), list("abcd"), n.sum(1))
    assert np.allclose(found.skill, s, atol=0.02)


def test_triplet_sums_against_brute_force():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, (6, 6))
    n = np.triu(n, 1) + np.triu(n, 1).T
    e = rng.normal(size=(6, 6))
    e = np.triu(e, 1) + np.triu(e, 1).T
    w = np.sqrt(n)
    for i, (top, bottom, alone) in enumerate(c.triplet_sums(n, e)):
        three = [(j, k) for j in range(6) for k in range(6) if len({i, j, k}) == 3]
        assert np.isclose(top, sum(w[i, j] * w[i, k] * w[j, k] * e[i, j] * e[i, k] for j, k in three))
        assert np.isclose(bottom, sum(w[i, j] * w[i, k] * w[j, k] * e[j, k] for j, k in three)) and np.isclose(alone, (n[i] * e[i]).sum())


def test_joined_pairs_give_what_matrices_give(spark):
    truth, rows = simulated(200, seed=8)
    votes = spark.createDataFrame(rows, "answer string, claim int, annotator string, label string")
    dense, _ = c.fit(votes, ["answer", "claim"], CLASSES, refinements=0)
    joined, _ = c.fit(votes, ["answer", "claim"], CLASSES, refinements=0, dense=2)
    assert dense.names == joined.names and np.allclose(dense.skill, joined.skill) and np.allclose(dense.together, joined.together) and np.allclose(dense.agree, joined.agree)


def test_usable_votes(spark):
    rows = [("A", 1, "g", " Supported ", "2024-01-01", 1), ("A", 1, "g", "NOT_A-CLAIM", "2024-01-02", 2), ("A", 1, "g", "see note", "2024-01-03", 3), ("A", 1, "h", "un supported", "2024-01-01", 4), ("A", 1, "i", None, "2024-01-01", 5), (None, 1, "j", "supported", "2024-01-01", 6), ("A", 2, "g", "contradicted", None, 7), ("A", 1, "g", "NOT_A-CLAIM", "2024-01-02", 2)]
    df = spark.createDataFrame(rows, SCHEMA.replace("t timestamp", "t string")).withColumn("label", F.lit("clash"))
    got = {(r["answer"], r["claim"], r["annotator"]): r["label"] for r in c.usable_votes(df, ["answer", "claim"], "grader", "support", "t", "r", CLASSES).collect()}
    assert got == {("A", 1, "g"): "not a claim", ("A", 2, "g"): "contradicted"}


def test_alpha_and_edges(spark):
    votes = spark.createDataFrame([(1, "a", "supported"), (1, "b", "supported"), (2, "a", "unsupported"), (2, "b", "supported"), (3, "a", "supported")], "item int, annotator string, label string")
    r = c.overall_agreement(votes, ["item"]).first()
    assert (r["items"], r["pairable_votes"], r["observed"]) == (2, 4, 0.5)
    assert c.consensus(votes, ["item"], CLASSES).count() == 2
    none = votes.limit(0)
    assert c.consensus(none, ["item"], CLASSES).count() == 0 and c.reliability(none, ["item"], CLASSES).count() == 0
    same = votes.where("label = 'supported' and item = 1")
    assert c.overall_agreement(same, ["item"]).first()["alpha"] is None
