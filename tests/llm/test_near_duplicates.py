import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import near_duplicates as nd


def texts(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = rng.sample(vocabulary, rng.choice([24, 25, 30, 60, 300]))
        out.append(" ".join(words))
    return out


def brute(rows, threshold=0.8, least=25):
    sets = {i: set(re.findall("[a-z0-9_]+", t.lower())) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= threshold * len(sets[p[0]] | sets[p[1]]) - 1e-12}


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_pairs_are_exactly_those_of_all_pairs(spark, threshold):
    rows = [(f"id{i:04d}", t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), ("null", None), ("empty", ""), ("long", "x y " * 50_000)], "id string, text string")
    df = df.withColumns({"key": F.lit(1), "words": F.lit("clash"), "n": F.lit(2)})
    got = {(r["id_a"], r["id_b"]) for r in nd.near_duplicate_pairs(df, threshold=threshold).collect()}
    assert got == brute(rows, threshold) and got


def test_groups_follow_links_and_count_copies(spark):
    base = [f"a{i}" for i in range(40)]
    near = [*base[1:], "other"]
    far = [f"z{i}" for i in range(40)]
    rows = [("3", " ".join(base)), ("1", " ".join(reversed(base))), ("2", " ".join(near)), ("4", " ".join(far))]
    out = {r["id"]: (r["group_id"], r["copies"], r["links"]) for r in nd.near_duplicate_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert out == {"1": ("1", 2, 1), "3": ("1", 2, 1), "2": ("1", 1, 1), "4": ("4", 1, 0)}


def test_hot_blocks_are_split_into_cells_without_loss(spark, monkeypatch):
    common = [f"c{i}" for i in range(60)]
    rows = [(f"{i:03d}", " ".join([*common, f"own{i}"])) for i in range(40)]
    monkeypatch.setattr(nd, "CELL_ROWS", 4)
    df = spark.createDataFrame(rows, "id string, text string")
    assert nd.near_duplicate_pairs(df).count() == 40 * 39 // 2


@pytest.mark.parametrize("few, most, blocks", [(1, 1 << 21, 1 << 18), (2, 5, 1 << 18), (1, 1 << 21, 0)])
def test_any_bound_of_counted_words_gives_the_same_pairs(spark, monkeypatch, few, most, blocks):
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "MOST_WORDS", most)
    monkeypatch.setattr(nd, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(nd, "CELL_ROWS", 8)
    rows = [(f"id{i:04d}", t) for i, t in enumerate(texts(seed=9))]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {(r["id_a"], r["id_b"]) for r in nd.near_duplicate_pairs(df).collect()} == brute(rows)
    words, n = nd._common_words(nd.classes_of(df, "id", "text", 25)[1])
    assert len(words) <= most and (len(n) == 0 or n.min() >= few)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (50, 50)]
    out = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "key_a int, key_b int")).collect()}
    assert all(out[i] == 0 for i in range(31)) and {out[i] for i in (100, 101, 102)} == {100} and 50 not in out


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert nd.near_duplicate_pairs(df).count() == 0 and nd.near_duplicate_groups(df).count() == 0


def test_components_settle_or_say_so(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "key_a int, key_b int")
    assert {r["root"] for r in nd.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        nd.components(chain, max_rounds=2)
