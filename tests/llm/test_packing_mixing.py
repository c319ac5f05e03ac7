import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, packing
from quillon.llm.tokens import with_token_counts


def test_nnls_reaches_the_exact_solution():
    x = packing.nnls([[(0, 1)], [(1, 2)], [(0, 1), (1, 1)]], np.array([5.0, 3.0]), 3000)
    assert np.allclose([x[0] + x[2], 2 * x[1] + x[2]], [5, 3], atol=1e-2) and (x >= 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_item_and_are_full(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([64, 512, 4096]))
    sizes = np.minimum(rng.lognormal(np.log(capacity / 4), 1.0, 4000).astype(int) + 1, capacity)
    histogram = np.bincount(sizes, minlength=capacity + 1)
    used, containers = np.zeros_like(histogram), 0
    for pattern, repeats in packing.plan(histogram, capacity):
        assert sum(s * t for s, t in pattern) <= capacity and repeats > 0
        for s, t in pattern:
            used[s] += t * repeats
        containers += repeats
    assert (used == histogram).all()
    # never worse than first fit decreasing by more than a container in a hundred
    bins: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= s), None)
        if at is None:
            bins.append(capacity - s)
        else:
            bins[at] -= s
    assert containers <= len(bins) * 1.01 + 1


def test_packing_places_each_piece_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 50)  # ranks counted in several salted groups
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 7, 7, 7, 40, 99, 100, 101, 250])) for i in range(400)] + [(None, 5), (1000, None)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc long, n long").withColumns({"id": F.lit(1), "size": F.lit(2)})
    out = packing.pack(df, [("a", 100), ("b", 256)], "doc", "n").toPandas()
    for name, capacity in (("a", 100), ("b", 256)):
        mine = out[out.window_name == name]
        assert mine["size"].sum() == sum(n for i, n in dict(rows).items() if i is not None and n)
        per = mine.sort_values("offset").groupby("container")
        for _, g in per:
            ends = (g["offset"] + g["size"]).tolist()
            assert ends[-1] <= capacity and g["offset"].tolist() == [0, *ends[:-1]]
        assert (mine.groupby("id").size() == [-(-dict(rows)[i] // capacity) for i in sorted(mine["id"].unique())]).all()
    assert packing.pack(df.limit(0), [("a", 100)], "doc", "n").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("a", 0)], "doc", "n")
    report = packing.fill_report(packing.pack(df, [("a", 100)], "doc", "n")).first()
    assert report["filled"] > 0.95


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "word " * 300_000)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(df, ["id"]).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and 299_000 < got[4] < 302_000


def test_flight_keeps_tokens_and_count():
    rng = random.Random(3)
    tokens = [rng.randrange(1, 900) for _ in range(500)]
    p = [rng.random() for _ in tokens]
    x = mixing.flight(tokens, p, 1)
    assert sum(0 < v < 1 for v in x) <= 2
    assert sum(a * t for a, t in zip(x, tokens)) == pytest.approx(sum(a * t for a, t in zip(p, tokens)), rel=1e-6)
    assert sum(x) == pytest.approx(sum(p), rel=1e-6)
    landed = mixing.flight(tokens, p, 1, land=True)
    assert set(landed) <= {0.0, 1.0} and sum(a * t for a, t in zip(landed, tokens)) == pytest.approx(sum(a * t for a, t in zip(p, tokens)), abs=20)


def test_flight_draws_with_the_given_probabilities():
    tokens, p = [5, 9, 2, 7, 3, 8, 4, 6], [0.1, 0.5, 0.9, 0.3, 0.7, 0.5, 0.2, 0.8]
    runs = np.array([mixing.flight(tokens, p, seed) for seed in range(4000)])
    assert np.abs(runs.mean(0) - p).max() < 0.03


def test_uses():
    exact = mixing.plan_uses({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4), "gone": (0.2, 9)})
    assert exact == {"a": 0.4, "b": 4.0}
    all_ = mixing.plan_uses({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4)}, "all")
    assert all_["b"] == 4.0 and all_["a"] == pytest.approx(0.7)
    assert mixing.plan_uses({}, {"a": (1.0, 1)}) == {}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)  # several levels of blocks
    rng = random.Random(6)
    rows = [(i, s, "word " * rng.randrange(1, 60)) for i, s in enumerate(["big"] * 600 + ["mid"] * 150 + ["tiny"] * 20 + [None] * 5 + ["other"] * 5)] + [(9999, "mid", None), (9998, "mid", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"p": F.lit(1), "block": F.lit(2)})
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.25, 2), ("tiny", 0.1, 3), ("gone", 0.05, None)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(df, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["big"]["reached_share"] == pytest.approx(0.6 / 0.95, abs=0.01) and got["tiny"]["reached_share"] == pytest.approx(0.1 / 0.95, abs=0.01)
    assert got["gone"]["reached_share"] == 0 and got["other"]["used_tokens"] == 0 and got[None]["copies"] == 0
    assert all(r["most_repeats"] <= {"big": 1, "mid": 2, "tiny": 3}.get(r["source"], 0) for r in got.values())
    assert mix.groupBy("doc_id").count().where("count > 1").count() == 0
    again = mixing.mix_sources(df.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))
    empty = mixing.mix_sources(df.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 4


def test_long_texts_have_the_tokens_of_the_whole():
    import os
    import random

    from quillon.llm import tokens

    rng = random.Random(6)
    text = "".join(rng.choice(["word", " ", " ", "  ", "\n", "\n\n", "x1", "é", ".", "don't", "\t "]) for _ in range(9000))
    assert "".join(tokens.pieces(text, 100)) == text and max(map(len, tokens.pieces(text, 100))) <= 100
    assert list(tokens.pieces("a" * 250, 100)) == ["a" * 100, "a" * 100, "a" * 50] and list(tokens.pieces("", 100)) == [""]
    if os.path.exists(tokens.DEFAULT_VOCABULARY):
        encode = tokens.encoding(tokens.DEFAULT_VOCABULARY).encode_ordinary
        assert [t for x in tokens.pieces(text, 2_000) for t in encode(x)] == encode(text)  # a place to cut is always near
