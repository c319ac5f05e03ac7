"""Which files are indexed: the ordered cascade of reasons to skip one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths


@dataclass(frozen=True)
class WalkLimits:
    max_file_bytes: int = 1_000_000
    max_config_bytes: int = 200_000
    max_line_chars: int = 2_000


# Names of files that hold secrets, of lock files and endings of generated ones (fixed values).
SECRET_NAME = r"(?i)^(\.env|.*\.pem|.*\.key|.*\.p12|.*\.pfx|.*\.keystore|.*\.jks|id_(rsa|dsa|ecdsa|ed25519)[^/]*|.*firebase-adminsdk.*\.json|.*\.tfstate(\.backup)?|\.npmrc|\.pypirc|\.netrc)$"
ENV_NAME = r"(?i)^\.env\..+$"
ENV_SAMPLE = r"(?i)\.(example|sample|template)$"
LOCK_NAMES = ("package-lock.json", "pnpm-lock.yaml", "go.sum", "bun.lockb")
GENERATED_ENDINGS = (".min.js", ".min.css", ".map", ".lock")
# Shapes of keys whose presence keeps a file out (fixed values, without look-around so that other engines can run them).
SECRET_TEXT = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bgithub_pat_[A-Za-z0-9_]{22}|\bxox[abprs]-[A-Za-z0-9-]{10}|\bAIza[A-Za-z0-9_-]{35}|\bsk-(ant-)?[A-Za-z0-9_-]{20}|\b[sr]k_live_[A-Za-z0-9]{16}"


def is_secret_name(path: Column) -> Column:
    name = paths.file_name(path)
    return name.rlike(SECRET_NAME) | (name.rlike(ENV_NAME) & ~name.rlike(ENV_SAMPLE))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.length(x)))


def skip_reason(path: Column, size: Column, text: Column, limits: WalkLimits = WalkLimits()) -> Column:
    """The first reason to leave a file out, in the order of the tests; null if it is indexed.

    A null text counts as unreadable; a null size as that of the text.
    """
    name, kind = paths.file_name(path), paths.kind_of(path)
    generated = name.isin(*LOCK_NAMES)
    for ending in GENERATED_ENDINGS:
        generated = generated | name.endswith(ending)
    most = F.when(kind == "config", limits.max_config_bytes).otherwise(limits.max_file_bytes)
    return (
        F.when(is_secret_name(path), "secret_file")
        .when(generated, "lockfile_or_generated")
        .when(kind.isNull(), "unsupported_type")
        .when(F.coalesce(size, F.octet_length(text).cast("long")) > most, "too_large")
        .when(text.isNull(), "unreadable")
        .when(F.instr(F.substring(text, 1, 8192), "\0") > 0, "binary")
        .when(~text.rlike(r"\S"), "empty")
        .when((kind != "doc") & (longest_line(text) > limits.max_line_chars), "minified_or_generated")
        .when(text.rlike(SECRET_TEXT), "secret_pattern")
    )


def walk_report(files: DataFrame, examples: int = 5) -> DataFrame:
    """``(reason, files, examples)``: how many files each reason leaves out and the first paths of each; null reasons are indexed."""
    first = Window.partitionBy("reason").orderBy("repo_id", "path")
    few = files.withColumn("n", F.row_number().over(first)).where(F.col("n") <= examples)
    shown = few.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda s: s["path"]), ", ").alias("examples"))
    counts = files.groupBy("reason").agg(F.count("*").alias("files"))
    return counts.join(shown.withColumnRenamed("reason", "r"), F.col("reason").eqNullSafe(F.col("r")), "left").select(F.coalesce("reason", F.lit("indexed")).alias("reason"), "files", "examples")
