import pytest
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.functions.citations import Span, check, numbers
from quillon.functions.claims import split_claims
from quillon.functions.describe import describe
from quillon.functions.identifiers import identifier_tokens, query_tokens, token_counts
from quillon.functions.intents import intent
from quillon.functions.replies import read_object, verdict


@pytest.mark.parametrize(
    "word, tokens",
    [("getUserById", "getuserbyid get user by id"), ("get_user_by_id", "get_user_by_id get user by id"), ("HTTPServer", "httpserver http server"), ("user", "user"), ("x = 1", ""), ("cart.js", "cart js"), ("_private", "private"), ("日本", "日本")],
)
def test_identifier_tokens(value, word, tokens):
    assert " ".join(value(identifier_tokens, t=word)) == tokens


def test_query_tokens_drop_stopwords_and_repeats(value):
    assert value(query_tokens, t="How does the user login work? user!") == ["user", "login", "work"]


def test_token_counts_of_a_table_equal_those_of_each_text(spark):
    df = spark.createDataFrame([(1, "getUser getUser user"), (2, ""), (3, None)], "id int, t string")
    got = {(r["id"], r["term"]): r["tf"] for r in token_counts(df, "id", F.col("t")).collect()}
    assert got == {(1, "getuser"): 2, (1, "get"): 2, (1, "user"): 3}


@pytest.mark.parametrize(
    "path, kind, language",
    [("web/Widget.TSX", "code", "tsx"), ("package.json", "config", "json"), ("Dockerfile", "config", "dockerfile"), (".env.example", "config", "dotenv"), ("firestore.rules", "config", "rules"), ("photo.png", None, None), ("Makefile.bak", None, None), ("noextension", None, None), ("a/README.md", "doc", "markdown")],
)
def test_kinds(value, path, kind, language):
    assert value(paths.kind_of, p=path) == kind
    assert value(paths.language_of, p=path) == language


@pytest.mark.parametrize("path, test", [("web/App.spec.tsx", True), ("pkg/thing_test.go", True), ("e2e/login.js", True), ("conftest.py", True), ("src/lib/latest.js", False), ("src/testing_utils.py", False)])
def test_test_paths(value, path, test):
    assert value(paths.is_test_path, p=path) is test


@pytest.mark.parametrize("path, notes", [("CHANGELOG.md", True), ("docs/release-notes-2.1.rst", True), ("HISTORY", True), ("src/history.py", False), ("news/today.md", False)])
def test_changelog_paths(value, path, notes):
    assert value(paths.is_changelog_path, p=path) is notes


def test_mentions(value):
    assert value(paths.mentions_tests, q="Where are the Mocks?") and not value(paths.mentions_tests, q="the latest")
    assert value(paths.mentions_changes, q="What changed?") and not value(paths.mentions_changes, q="exchange")


def test_directories(value):
    assert value(paths.directories, p="a/b/c.py") == ["a", "a/b"]
    assert value(paths.directories, p="c.py") == []


def test_text_forms(value):
    assert value(text.estimate_tokens, t="") == 1 and value(text.estimate_tokens, t="abcde") == 2
    assert value(lambda t: text.clip(t, 8), t="one  two three") == "one two…"
    assert value(text.code_fence, t="a ```` b") == "`````" and value(text.code_fence, t="x") == "```"
    assert value(text.safe_cell, t="=1+1") == "'=1+1" and value(text.safe_cell, t="a=1") == "a=1"
    assert value(text.clean_rewrite, t="\n\n Standalone question: \"Where is it?\"\nmore") == "Where is it?"
    assert value(text.symbol_parent, s="A.B.c") == "A.B" and value(text.symbol_leaf, s="A.B.c") == "c" and value(text.symbol_parent, s="c") is None
    assert value(text.model_size, s="coder:7b") == 7.0 and value(text.model_size, s="coder:latest") is None
    assert value(lambda w: text.context_budget(w, F.lit(12000), F.lit(4000), F.lit(1000)), w=8192) == 4065


@pytest.mark.parametrize(
    "url, good", [("https://git.example/a/b.git", True), ("git@git.example:a/b.git", True), ("ssh://git@git.example/a", True), ("https://u:p@git.example/a", False), ("-oProxy=x", False), ("https://git.example/a b", False), ("file:///etc", False), ("https://git.example/../x", False)]
)
def test_git_urls(value, url, good):
    assert value(text.is_git_url, u=url) is good


SOURCES = [Span("app/users.py", 1, 40), Span("app/cart.js", 5, 9), Span("docs/a.md", 1, 3)]


@pytest.mark.parametrize(
    "answer, cited, invalid, clean",
    [
        ("Yes [1-3].", [1, 2, 3], [], "Yes [1-3]."),
        ("Yes [2–3].", [2, 3], [], "Yes [2–3]."),
        ("Yes [Source 2].", [2], [], "Yes [Source 2]."),
        ("Yes [1][9].", [1], [9], "Yes [1]."),
        ("Yes [7][8].", [], [7, 8], "Yes [?]."),
        ("Yes [2, 9].", [2], [9], "Yes [2]."),
        ("Yes [0].", [], [0], "Yes [?]."),
        ("Yes [1-999999].", [1], [999999], "Yes [1]."),
        ("rows[2][3], parse(x)[1] and matrix[1][2]", [], [], "rows[2][3], parse(x)[1] and matrix[1][2]"),
        ("`a [1]` and\n```\nb [2]\n```\n", [], [], "`a [1]` and\n```\nb [2]\n```\n"),
        ("Both [1 and 2].", [1, 2], [], "Both [1 and 2]."),
        ("Claim [9][Source 1].", [1], [9], "Claim [Source 1]."),
        ("Claim [7], also [8].", [], [7, 8], "Claim [?], also [?]."),
        ("Read matrix[1][2] here [3].", [3], [], "Read matrix[1][2] here [3]."),
        ("See [the docs](http://x.y) [2].", [2], [], "See [the docs](http://x.y) [2]."),
        ("Open `code [1]\nand ```b [2]", [1, 2], [], "Open `code [1]\nand ```b [2]"),
        ("", [], [], ""),
    ],
)
def test_citations(answer, cited, invalid, clean):
    r = check(answer, SOURCES)
    assert (r.cited, r.invalid, r.clean_text) == (cited, invalid, clean)
    assert r.uncited == [n for n in (1, 2, 3) if n not in cited]


def test_locations():
    assert check("see app/users.py:12-20 and users.py:3", SOURCES).unverified == []
    assert check("see pp/users.py:12-20, cart.js:4 and `users.py:41`", SOURCES).unverified == ["pp/users.py:12-20", "cart.js:4", "users.py:41"]
    assert check("On localhost:8080, example.com:443, version 1.2:3.", SOURCES).unverified == []
    assert check("```\nat app/billing.py:12\n```\napp/users.py:30-20", SOURCES).unverified == ["app/users.py:30-20"]
    assert numbers("3-1") == [3, 1] and numbers("the docs") is None and numbers("") is None


@pytest.mark.parametrize(
    "answer, claims",
    [
        ("It sends it. [2] Then it stops.", ["It sends it. [2]", "Then it stops."]),
        ("Use a tool, e.g. this one. Done.", ["Use a tool, e.g. this one.", "Done."]),
        ("- First point\n- Second point [1].", ["First point", "Second point [1]."]),
        ("Look:\n```python\nx = 1. y\n```\nEnd.", ["Look:", "End."]),
        ("# Title\n\nText! More?", ["Title", "Text!", "More?"]),
    ],
)
def test_claims(answer, claims):
    assert split_claims(answer) == claims


@pytest.mark.parametrize(
    "question, expected",
    [
        ("What does this project do?", "identity"),
        ("What is the purpose of this repository?", "purpose"),
        ("Is this a web framework?", "kind"),
        ("Give me an overview", "overview"),
        ("Give me an overview of the cart", None),
        ("How is this codebase organized?", "structure"),
        ("the architecture of the cache layer", None),
        ("What are the main modules?", "parts"),
        ("How does it all fit together?", "fit"),
        ("What tech stack is used?", "stack"),
        ("Where should I start?", "onboarding"),
        ("What does `parse_args` do in this project?", None),
        ("  WHAT   DOES  THIS   PROJECT  DO ?  ", "identity"),
        ("Can you give me a high-level view of how this works?", "overview"),
        ("Walk me through the project", "overview"),
        ("Is this a web app, a library or a CLI tool?", "kind"),
        ("How is this software put together?", "structure"),
        ("Explain how everything fits together.", "fit"),
        ("How do the different parts fit together?", "parts"),
        ("Which languages and frameworks does it use?", "stack"),
        ("I'm new here. Where should I start reading?", "onboarding"),
        ("What are the main components of the Kanban board?", None),
        ("Explain the architecture of the email pipeline", None),
        ("How does src/app/user_service.py validate emails?", None),
        ("Where is getTaskFiltersForUser defined?", None),
        ("Give me a tour of the payment module.", None),
        ("What are the building blocks of the parser?", None),
        ("Which framework does the router use?", None),
        ("How does everything in the checkout fit together?", None),
        ("What problem does the rate limiter solve?", None),
        ("   ", None),
        ("", None),
        (None, None),
    ],
)
def test_intents(question, expected):
    assert intent(question) == expected


def test_replies(spark):
    assert read_object('Sure: {"a": 1} and more') == ({"a": 1}, None)
    assert read_object("none")[0] is None and read_object("{bad")[0] is None
    df = spark.createDataFrame([('ok {"verdict": "supported", "reason": "r"} tail',), ('{"verdict": "great"}',), (None,)], "t string")
    rows = [r["v"] for r in df.select(verdict(F.col("t")).alias("v")).collect()]
    assert rows[0]["verdict"] == "supported" and rows[1]["verdict"] is None and "great" in rows[1]["error"] and rows[2]["error"]


@pytest.mark.parametrize(
    "head, language, expected",
    [
        ('"""Core logic. More."""\n', "python", "Core logic."),
        ("# comment\n'''\n====\npkg.mod\nParses things quickly.\n'''", "python", "Parses things quickly."),
        ("/*\n * Copyright someone\n * Draws the cart.\n */", "javascript", "Draws the cart."),
        ("#!/bin/sh\n# Builds the site.\nset -e", "shell", "Builds the site."),
        ("# Setup\n\ntext", "markdown", "Setup"),
        ("Title\n=====\n", "rst", "Title"),
        ("x = 1", "python", None),
        ("# just a comment\nimport os\n", "python", None),
        ('"""Cut off here and\nmore', "python", "Cut off here and"),
        ("'use strict';\n\n// Shared mailer.\nmodule.exports = {};\n", "javascript", "Shared mailer."),
        ("// @ts-check\nconst a = 1;\n", "javascript", None),
        ("/* first\n" + "\n" * 60 + " */", "go", None),
        ("//\n" * 60 + "// Says it late.\n", "go", "Says it late."),
        (None, "go", None),
    ],
)
def test_describe(head, language, expected):
    assert describe(head, language) == expected


def test_hashed_vectors_are_those_of_the_embedder_and_bring_like_texts_together(spark):
    from quillon.functions.embedding import HashEmbedder, embed, hashed_vector

    df = spark.createDataFrame([(1, "read the user table"), (2, "read the user row"), (3, "zebra"), (4, "")], "id int, t string")
    rows = {r["id"]: r["v"] for r in df.select("id", hashed_vector(F.col("t")).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b]))
    assert abs(dot(1, 1) - 1) < 1e-9 and dot(1, 2) > dot(1, 3) and rows[4][0] == 1.0
    with pytest.raises(ValueError):
        hashed_vector(F.col("t"), 100)
    assert all(len(r["embedding"]) == 32 for r in embed(df, HashEmbedder(32), ["id"], "t", batch=2).collect())
