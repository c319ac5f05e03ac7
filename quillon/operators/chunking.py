"""Files into chunks with exact line ranges: windows inside the JVM, headings and definitions in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import chunk_id
from quillon.operators import structure

MAX_LINES, WINDOW_LINES, WINDOW_OVERLAP = 120, 60, 10
CONTENT = r"[\p{L}\p{N}_]"


def line_count(text: Column) -> Column:
    """Lines up to the last that isn't blank."""
    kept = F.regexp_replace(text, r"\s+$", "")
    return F.length(kept) - F.length(F.replace(kept, F.lit("\n"), F.lit(""))) + 1


def window_starts(lines: Column, window: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> Column:
    """0-based first lines of windows that overlap by ``overlap`` lines, the last of which ends with the file."""
    if not (window > 0 and 0 <= overlap < window):
        raise ValueError("a window needs at least one line and an overlap shorter than itself")
    return F.sequence(F.lit(0), F.greatest(F.lit(0), lines - overlap - 1), F.lit(window - overlap))


def window_chunks(files: DataFrame, window: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """``(repo_id, path, language, kind, symbol, start_line, end_line, text, file_hash)``: the windows that have any word.

    ``files`` has ``repo_id, path, language, text, file_hash``; null and blank texts give no rows.
    """
    rows = files.where(F.col("text").rlike(CONTENT)).withColumn("n", line_count(F.col("text"))).withColumn("lines", F.split("text", "\n", -1))
    cut = rows.select("repo_id", "path", "language", "file_hash", "lines", "n", F.explode(window_starts(F.col("n"), window, overlap)).alias("s"))
    cut = cut.withColumn("e", F.least(F.col("s") + window, F.col("n")))
    text = F.array_join(F.slice("lines", F.col("s") + 1, F.col("e") - F.col("s")), "\n")
    out = cut.select("repo_id", "path", "language", F.lit("window").alias("kind"), F.lit(None).cast("string").alias("symbol"), (F.col("s") + 1).alias("start_line"), F.col("e").cast("int").alias("end_line"), text.alias("text"), "file_hash")
    return out.where(F.col("text").rlike(CONTENT))


CHUNK_SCHEMA = "repo_id string, path string, language string, kind string, symbol string, start_line int, end_line int, text string, file_hash string"


def structured_chunks(files: DataFrame, max_lines: int = MAX_LINES, window: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Chunks by structure: definitions of code, headings of markdown, windows for all else and where no structure is found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in b.itertuples(index=False):
                for c in structure.chunk_text(f.text, f.language, max_lines, window, overlap):
                    rows.append((f.repo_id, f.path, f.language, c.kind, c.symbol, c.start + 1, c.end + 1, c.text, f.file_hash))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

    return files.select("repo_id", "path", "language", "text", "file_hash").where("text is not null").mapInPandas(run, CHUNK_SCHEMA)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with their ids; equal ids are equal chunks and stay once."""
    key = chunk_id(F.col("repo_id"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text"))
    return chunks.withColumn("id", key).dropDuplicates(["id"])


def coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(repo_id, path, lines, covered)``: lines with any word, and how many of them lie in a chunk of the file."""
    content = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(line.rlike(CONTENT), i + 1)), lambda n: n.isNotNull())
    lines = files.where(F.col("text").rlike(CONTENT)).select("repo_id", "path", content.alias("content"))
    spans = chunks.groupBy("repo_id", "path").agg(F.collect_set(F.struct("start_line", "end_line")).alias("spans"))
    inside = F.filter("content", lambda n: F.exists("spans", lambda s: n.between(s["start_line"], s["end_line"])))
    both = lines.join(spans, ["repo_id", "path"], "left")
    return both.select("repo_id", "path", F.size("content").cast("long").alias("lines"), F.when(F.col("spans").isNull(), 0).otherwise(F.size(inside)).cast("long").alias("covered"))
