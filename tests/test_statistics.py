import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import statistics as st
from quillon.operators import study


@pytest.mark.parametrize("b, w, p", [(10, 0, 2 / 2**10), (3, 1, 0.625), (5, 5, 1.0), (0, 0, 1.0), (17, 18, 1.0), (1, 8, 20 / 512)])
def test_sign_test(value, b, w, p):
    assert value(st.sign_test, b=b, w=w) == pytest.approx(p, abs=1e-9)


def test_sign_test_of_large_counts(value):
    assert 0 < value(st.sign_test, b=2400, w=2600) < 0.01


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: round(r["p_holm"], 6) for r in st.holm(df).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_kappa(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")], "a string, b string")
    r = st.cohen_kappa(df, "a", "b").first()
    assert (r["n"], r["observed"], r["kappa"]) == (50, 0.7, 0.4)
    assert st.cohen_kappa(df.where("a = 'y' and b = 'y'"), "a", "b").first()["kappa"] is None


def test_alpha(spark):
    units = {1: "aa", 2: "ab", 3: "bb", 4: "bb", 5: "aa", 6: "c"}
    df = spark.createDataFrame([(u, x) for u, xs in units.items() for x in xs], "unit int, label string")
    # coincidences: 4 a-a, 4 b-b, 1 a-b, 1 b-a; n = 10, totals 5 and 5
    assert st.krippendorff_alpha(df, ["unit"], "label").first()["alpha"] == pytest.approx(1 - 9 * 2 / 50, abs=1e-6)
    assert st.krippendorff_alpha(df.where("label = 'a'"), ["unit"], "label").first()["alpha"] is None


def test_paired(spark):
    df = spark.createDataFrame([("p", 1, 1.0, 0.5), ("p", 2, 0.5, 0.5), ("p", 3, 0.0, 1.0), ("p", 4, 1.0, 0.0)], "pair string, q int, a double, b double")
    r = st.paired_counts(df, "a", "b", ["pair"]).first()
    assert (r["n"], r["better"], r["worse"], r["tied"], r["sign_p"]) == (4, 2, 1, 1, 1.0)
    b = st.paired_bootstrap(df, "a", "b", "pair", "q", 500).first()
    assert b["ci_low"] <= 0.125 <= b["ci_high"] and not b["significant"]
    assert b == st.paired_bootstrap(df.orderBy(F.desc("q")), "a", "b", "pair", "q", 500).first()


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([("c", f"k{i % 5}", 1.0 if i % 3 else 0.0) for i in range(60)], "by string, cluster string, v double")
    r = st.cluster_bootstrap(df, "v", "cluster", "by", resamples=800).first()
    assert r["low"] < r["estimate"] < r["high"] and r["clusters"] == 5 and r["p"] < 0.05


def test_exact_share(spark):
    low, high = st.clopper_pearson(8, 10)
    assert (round(low, 4), round(high, 4)) == (0.4439, 0.9748)
    assert st.clopper_pearson(0, 5)[0] == 0.0 and st.clopper_pearson(5, 5)[1] == 1.0
    assert st.binomial_tail(8, 10, 0.5) == pytest.approx(56 / 1024)
    df = spark.createDataFrame([(8, 10)], "k int, n int")
    assert st.share_test(df, "k", "n").first()["p_greater"] == pytest.approx(56 / 1024)


def test_power(spark):
    grid = spark.createDataFrame([(50, 0.3, 0.0, 0.05), (200, 0.3, 0.2, 0.05)], "n int, discordance double, difference double, alpha double")
    rows = {r["n"]: r["power"] for r in st.power_grid(grid, 2_000).collect()}
    assert rows[50] < 0.06 and rows[200] > 0.95


def test_worst_label_and_faithfulness(spark):
    rows = [("A", 1, "supported"), ("A", 1, "contradicted"), ("A", 2, "not a claim"), ("A", 2, "supported"), ("B", 1, "not a claim"), ("B", 2, "supported"), ("B", 3, "odd")]
    df = spark.createDataFrame(rows, "code string, claim int, label string")
    folded = study.fold_claims(df, ["code", "claim"])
    assert {(r["code"], r["claim"]): r["label"] for r in folded.collect()} == {("A", 1): "contradicted", ("A", 2): "supported", ("B", 1): "not a claim", ("B", 2): "supported"}
    assert {r["code"]: r["faithful"] for r in study.faithful_answers(folded, ["code"]).collect()} == {"A": False, "B": True}


def test_pairing_and_discordant(spark):
    rows = [(q, p, o, i) for i, (q, p, o) in enumerate([(1, "P0", 0), (1, "P1", 1), (2, "P0", 1), (2, "P1", 1), (3, "P0", 1), (4, "P0", 0), (4, "P1", None), (1, "P0", 1)])]
    df = spark.createDataFrame(rows, "q int, prompt string, o int, i int")
    wide = study.paired(df, ["q"], "prompt", "P0", "P1", "o", "i")
    assert sorted(map(tuple, wide.collect())) == [(1, 0, 1), (2, 1, 1)]
    r = study.discordant(wide, "P0", "P1").first()
    assert (r["gained"], r["lost"], r["p"]) == (1, 0, 1.0)


def test_study_helpers(spark):
    df = spark.createDataFrame([("m", 1, None), ("m", 2, "e"), ("m", 2, None)], "model string, id int, error string")
    assert study.without_failed(df, ["model", "id"]).count() == 1
    both = study.intention_to_treat(df.select("model", "id"), df.where("error is not null"))
    assert both.count() == 4 and math.isclose(both.where("error is null").count(), 3)
    sets = study.sets_of(df, {"all": F.lit(True), "failed": F.col("error").isNotNull()})
    assert {r["subset"]: r["count"] for r in sets.groupBy("subset").count().collect()} == {"all": 3, "failed": 1}
