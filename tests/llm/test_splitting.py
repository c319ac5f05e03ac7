import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import splitting as sp


def covers(text, pieces, max_chars, max_lines):
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        body = text[p.start : p.end]
        assert len(body) <= max_chars and body.count("\n") + 1 <= max_lines
        assert text.count("\n", 0, p.start) == p.start_line and p.start_line + body.count("\n") == p.end_line
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end + 1 and a.end < b.end
        assert text[a.end : b.start] in ("", "\n") or b.start <= a.end


@pytest.mark.parametrize("seed", range(25))
def test_pieces_are_slices_within_the_limits_that_cover_the_text(seed):
    rng = random.Random(seed)
    lines = [" " * rng.randrange(0, 9) + " ".join(rng.choice(["alpha", "beta();", "x", "{", "}", "é"]) for _ in range(rng.choice([0, 1, 5, 12, 400 if rng.random() < 0.1 else 3]))) for _ in range(rng.randrange(1, 400))]
    text = "\n".join(lines)
    pieces = sp.split(text, 900, 40, rng.choice([0, 3, 10]))
    covers(text, pieces, 900, 40)


def test_one_endless_line_and_blank_lines():
    text = "a;" * 5_000 + "b" * 20_000
    pieces = sp.split(text)
    covers(text, pieces, 6_000, 120)
    assert text[pieces[0].end - 1] == ";"
    blank = "\n" * 500
    covers(blank, sp.split(blank), 6_000, 120)


def test_cuts_where_the_topic_changes_and_overlaps_as_asked():
    a = "\n".join(f"    parser token stream {i}" for i in range(70))
    b = "\n".join(f"    invoice total customer {i}" for i in range(70))
    text = f"def parse():\n{a}\n\ndef bill():\n{b}"
    pieces = sp.split(text, 60_000, 120, 5)
    assert text.split("\n")[pieces[0].end_line + 1] == "def bill():"
    assert pieces[1].start_line == pieces[0].end_line + 1 - 5


def test_limits():
    assert len(sp.split("x" * 6_000)) == 1 and len(sp.split("x" * 6_001)) == 2
    assert len(sp.split("\n".join(["x"] * 120))) == 1 and len(sp.split("\n".join(["x"] * 121))) == 2


def test_table(spark):
    long = "\n".join(f"line {i}" for i in range(300))
    rows = [("a", 11, long), ("a", 11, long), ("b", None, long), ("c", 1, "short"), ("d", 1, None), (None, 1, long), ("e", 1, "")]
    df = spark.createDataFrame(rows, "id string, start_line int, text string").withColumns({"piece": F.lit(0), "first": F.lit(0)})
    out = sp.split_oversized(df)
    assert {r["id"] for r in out.collect()} == {"a", "b", None}
    a = out.where("id = 'a'").orderBy("piece").collect()
    lines = long.split("\n")
    assert all(r["text"] == "\n".join(lines[r["start_line"] - 11 : r["end_line"] - 10]) for r in a) and [r["piece"] for r in a] == list(range(1, a[0]["pieces"] + 1))
    assert out.where("id = 'b'").agg(F.min("start_line")).first()[0] == 1
    assert sp.split_oversized(df.limit(0)).count() == 0
