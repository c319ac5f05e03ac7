import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import pairs

Q = "What happens to the batch size when `split_signal` fails?"


@pytest.mark.parametrize(
    "answer, expected",
    [
        (None, ["empty"]), ("", ["empty"]), (" \n", ["empty"]), ("​", ["empty"]), ("[1][3]", ["empty"]), ("N/A", ["empty"]), ("(no answer)", ["empty"]), ("```\n```", ["empty"]), ("# Answer", ["empty"]), ("``", ["empty"]),
        ("`limit/region.java` [1]", []), ("[3] `group/key.py`", []), ("`a_b`, see [2].", []),
        ("The parser reads it first. [2]", []), ("The parser reads it first. The ranking stag", ["truncated"]), ("It uses `split_sig", ["truncated"]), ("Look:\n\n```python\ndef f(:\n    x", ["truncated"]), ("Look.\n\n```python\nx = 1\n```", []), ("Files are listed.\n\n- `a.py`\n- `b.py` [1]", []), ("It waits 3 seconds [1", ["truncated"]),
        ("I'm sorry, but I can't help with that.", ["refusal"]), ("This request was blocked by the content policy.", ["refusal"]), ("The answer cannot be derived from the sources: `x` is imported but its body is not included.", []), ("I could not find `x` in the excerpts; it is only mentioned.", []), ("It cannot be changed at run time, sorry about the confusing name.", []), ('The log says "I cannot help with that" and stops.', []),
        (Q, ["copies_question"]), ("You asked: what happens to the batch size when split_signal fails", ["copies_question"]), (Q + " The scheduler keeps it and ignores the second call, so nothing is lost.", []),
        ("Diese Seite beschreibt, wie der Parser aufgebaut ist und welche Rolle `split_signal` dabei spielt.", ["other_language"]), ("Lo siento, pero no puedo ayudar con esa petición.", ["refusal", "other_language"]),
        ('The message "die Datei ist nicht da" comes from the tracker.', []),
    ],
)
def test_defects(answer, expected):
    assert pairs.defects(Q, answer) == expected


def test_questions_in_other_languages():
    assert pairs.defects("Wie geht `x` damit um, wenn die Datei fehlt?", "Der Parser liest die Datei, bevor er sie ändert.") == []
    assert pairs.defects("Como `x` trata o caso em que falta o arquivo?", "El planificador compara la lista con lo que `x` devolvió anteriormente, y luego espera.") == ["other_language"]
    assert pairs.defects(None, "A sound answer.") == []


@pytest.mark.parametrize(
    "sentence, declines",
    [
        ("I can not answer.", True), ("Sorry, that is off limits for me.", True), ("I'm really not able to go into that.", True), ("My rules don't allow me to say more.", True), ("We're unable to assist.", True), ("Das darf ich nicht beantworten.", True), ("Je ne peux pas vous aider.", True), ("Ik kan je daar niet mee helpen.", True),
        ("The loader will refuse to open files over 2 GB.", False), ("The server cannot provide a token until the user logs in.", False), ("Guests are not permitted to write to the bucket.", False), ("We cannot share the lock across threads.", False), ("I can't answer that from the excerpts.", False), ("Das Skript kann dabei nicht helfen.", False), ("The policy does not allow retries.", False), ("", False),
    ],
)
def test_refusals_need_a_speaker(sentence, declines):
    assert pairs.refuses(pairs.spoken(sentence)) is declines


def test_word_automaton_against_brute_force():
    rng = random.Random(4)
    runs = ("a ~ b", "A ? c", "b c A")
    automaton = pairs.WordAutomaton(runs, {"A": "d e"}, gap=2)
    for _ in range(500):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(8))]
        text = "".join(words)
        import re

        assert automaton.accepts(words) == bool(re.search("a.{0,2}b|[de].?c|bc[de]", text)), text


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max([n for n in range(i + 2) if tuple(b[i + 1 - n : i + 1]) in runs], default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).matches(b) == want


def test_table(spark):
    rows = [(1, Q, None), (1, Q, None), (2, None, None), (3, "", "A sound one."), (4, Q, "word " * 200_000), (None, Q, "N/A")]
    df = spark.createDataFrame(rows, "result_id long, question string, answer string").withColumn("defect", F.lit("clash"))
    got = sorted(map(str, pairs.broken_pairs(df).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(1, "empty"), (2, "empty"), (4, "truncated"), (None, "empty")], "result_id long, defect string").collect()))
    assert pairs.broken_pairs(df.limit(0)).count() == 0
