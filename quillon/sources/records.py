"""Question files, run results, judge files and grading sheets; reports and sheets written out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import stored

QUESTION_SCHEMA = "id string, question string, type string, gold_files array<string>, acceptable_files array<string>, gold_symbols array<string>, gold_dirs array<string>, key_facts array<string>"


class QuestionFileError(ValueError):
    """A question file that breaks a rule; the message names file and line."""


def checked_questions(spark: SparkSession, path: str) -> DataFrame:
    """A file of JSON lines with ``line`` and ``problem`` (null for sound rows): bad JSON, missing fields, gold that contradicts the type, repeated ids."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")).where(F.col("value").rlike(r"\S"))
    rows = raw.select((F.col("pos") + 1).alias("line"), "value", F.from_json("value", QUESTION_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("q"))
    rows = rows.select("line", "value", "q.*")
    gold = F.coalesce(F.size("gold_files"), F.lit(0)) + F.coalesce(F.size("gold_dirs"), F.lit(0))
    blank = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"\S")
    again = F.count("*").over(Window.partitionBy("id")) > 1
    problem = (
        F.when(F.col("_bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{"), "not a JSON object of the expected types")
        .when(blank("id"), "no id")
        .when(blank("question"), "no question")
        .when((F.col("type") == "unanswerable") & (gold > 0), "unanswerable but with gold")
        .when((F.coalesce("type", F.lit("")) != "unanswerable") & (gold == 0), "no gold files or directories")
        .when(again, "id occurs more than once")
    )
    return rows.withColumn("problem", problem).drop("_bad", "value")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a file; raises for the first line that breaks a rule and for an empty file."""
    rows = checked_questions(spark, path)
    first = rows.where("problem is not null").orderBy("line").limit(1).collect()
    if first:
        raise QuestionFileError(f"{path}:{first[0]['line']}: {first[0]['problem']}")
    if rows.isEmpty():
        raise QuestionFileError(f"{path}: no questions")
    return rows.drop("problem", "line")


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where("type is distinct from 'unanswerable'")


def symbol_lookups(questions: DataFrame) -> DataFrame:
    """Questions that are just the first gold symbol of another question, to test exact names."""
    return questions.where(F.size("gold_symbols") > 0).select(F.concat("id", F.lit("-sym")).alias("id"), F.get("gold_symbols", 0).alias("question"), F.lit("symbol").alias("type"), "gold_files", "acceptable_files")


RESULT_SCHEMA = "env struct<model string, questions_file string, retrieval string>, results array<struct<id string, question string, answer string, error string, grounded boolean, precision double, gold_cited boolean, unverified_locations int>>"


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """One row per answer of ``<repo>/<prompt>-<context>/<model>.json`` files; the path gives repository, prompt and context."""
    raw = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(f"{folder}/*/*/*.json").withColumn("results_file", F.col("_metadata.file_path"))
    part = F.split("results_file", "/")
    setting = F.element_at(part, -2)
    rows = raw.select("results_file", "env.model", F.element_at(part, -3).alias("repo"), F.substring_index(setting, "-", 1).alias("prompt"), F.regexp_extract(setting, "^[^-]*-(.*)$", 1).alias("context"), F.explode("results").alias("r"))
    return rows.select("results_file", "model", "repo", "prompt", "context", F.col("r.id").alias("question_id"), F.col("r.error").isNotNull().alias("failed"), F.coalesce("r.grounded", F.lit(False)).alias("grounded"), F.col("r.precision").alias("precision"), F.col("r.gold_cited").cast("double").alias("gold_cited"), (F.coalesce("r.unverified_locations", F.lit(0)) > 0).alias("unverified_location"))


def load_judge_file(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a judge's JSON lines whose first line names the judge; failed rows are left out."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    head = lines.select("file", F.get_json_object("value", "$._run.judge").alias("judge")).where("judge is not null")
    rows = lines.where("get_json_object(value, '$._run') is null").select("file", F.from_json("value", "results_file string, question_id string, claim int, label string, by string, error string").alias("r"))
    named = rows.join(head.groupBy("file").agg(F.first("judge").alias("judge")), "file")
    return named.where("r.error is null").select(F.regexp_replace("judge", "^[^/]*/", "").alias("judge"), "r.results_file", "r.question_id", "r.claim", "r.label", "r.by")


def load_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A graded CSV sheet: byte order mark dropped, all cells trimmed, empty cells as ''."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c.lstrip("﻿") for c in raw.columns]
    return raw.toDF(*names).select([F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names])


def unknown_labels(sheet: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """The cells that hold none of the allowed labels; blank cells are fine."""
    return sheet.where((F.col(column) != "") & ~F.lower(column).isin(*allowed))


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file with a header, cells guarded against formulas; refuses a folder that exists."""
    from quillon.functions.text import safe_cell

    cells = [safe_cell(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    df.select(cells).coalesce(1).write.mode("errorifexists").csv(path, header=True, escape='"')


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """What is left of a run: rows without a result that succeeded."""
    return todo.join(done.where(F.col(error).isNull()).select(*keys).distinct(), list(keys), "left_anti")


def merge_results(done: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new results; the new ones hold."""
    return done.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def opaque_codes(answers: DataFrame, key: str, seed: str = "0") -> DataFrame:
    """Adds ``code``: answers numbered in an order that tells nothing about them.

    Numbers are ranks within ranges of the hash and what the ranges before hold, so no task sorts all rows.
    """
    hashed = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))
    keys = answers.select(key).distinct().withColumn("h", hashed)
    ranged = stored(keys.repartitionByRange("h", key).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row per range
    number = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("h", key))
    return answers.join(ranged.join(offsets, "part").select(key, F.format_string("A%05X", number).alias("code")), key)


def sample_for_review(rows: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """A sample without replacement that depends on the ids alone: the rows with the smallest hashes."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(size)


def synthetic_files(spark: SparkSession, n: int, functions: int = 7) -> DataFrame:
    """Made-up source files for tests of scale: ``repo_id, path, language, text, file_hash``; no data is read."""
    body = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(functions)), lambda k: F.format_string("def handle_%d_%d(request, user_id):\n    \"\"\"Handles step %d of module %d.\"\"\"\n    return request.load(user_id) + %d\n", F.col("id"), k, k, F.col("id"), k)), "\n\n"
    )
    rows = spark.range(n).select(F.lit("synthetic").alias("repo_id"), F.format_string("pkg%d/module_%d.py", F.col("id") % 100, F.col("id")).alias("path"), F.lit("python").alias("language"), body.alias("text"))
    return rows.withColumn("file_hash", F.sha2("text", 256))


def grading_batch(answers: DataFrame, claims: DataFrame, folder: str, seed: str = "0") -> None:
    """Blind sheets for graders: ``answers``, ``claims`` and, apart from them, the ``key`` from codes to results.

    ``answers`` has ``result_id, question, answer``, ``claims`` has ``result_id, claim, text, cites``.  Existing folders are refused.
    """
    coded = opaque_codes(answers, "result_id", seed)
    blank = [F.lit("").alias(c) for c in ("correctness", "flag", "note", "minutes")]
    write_sheet(coded.select(F.col("code").alias("answer"), "question", F.col("answer").alias("text"), *blank).orderBy("answer"), f"{folder}/answers")
    named = claims.join(coded.select("result_id", "code"), "result_id")
    write_sheet(named.select(F.col("code").alias("answer"), "claim", "cites", "text", F.lit("").alias("support"), F.lit("").alias("note")).orderBy("answer", "claim"), f"{folder}/claims")
    coded.select("code", "result_id").coalesce(1).write.mode("errorifexists").json(f"{folder}/key")
