"""``python -m quillon``: index a directory, search it, look at it, and check question files."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.text import location
from quillon.operators import metrics, search, walking
from quillon.operators.answering import ProviderError
from quillon.operators.evaluation import markdown
from quillon.operators.indexing import KeywordIndex
from quillon.operators.retrieval import Answerer, Retriever
from quillon.operators.structure import chunk_text
from quillon.session import create_session, importable
from quillon.sources import records
from quillon.sources.models import create_provider
from quillon.sources.repository import RepositorySource, load
from quillon.sources.settings import Settings
from quillon.sources.tables import CHUNKER_VERSION, IndexMismatchError, VersionedTables
from quillon.streaming.incremental import apply_batch


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession() or create_session(app="quillon")
    importable(spark)
    return spark


def _keyword(tables: VersionedTables) -> KeywordIndex:
    return KeywordIndex(tables.read("postings"), tables.read("lengths"), tables.read("frequencies"))


def index(root: str, place: str) -> int:
    if not os.path.isdir(root):
        print(f"{root} is no directory", file=sys.stderr)
        return 2
    spark = _session()
    spark.dataSource.register(RepositorySource)
    tables = VersionedTables(spark, place)
    tables.check(chunker=CHUNKER_VERSION)
    walked = spark.read.format("repository").load(root)
    reason = F.coalesce("skipped", walking.skip_reason(F.col("path"), F.col("size"), F.col("text")))
    rows = walked.withColumns({"repo_id": F.lit(os.path.basename(os.path.realpath(root))), "reason": reason, "language": paths.language_of(F.col("path"))}).cache()
    kept = rows.where("reason is null").select("repo_id", "path", "language", "text", "file_hash")
    if tables.is_built():  # files that are gone come as removals
        mine = tables.read("manifest").join(rows.select("repo_id").distinct(), "repo_id", "left_semi")
        gone = mine.join(kept.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        none = lambda n: F.lit(None).cast("string").alias(n)
        kept = kept.unionByName(gone.select("repo_id", "path", none("language"), none("text"), none("file_hash")))
    counts = apply_batch(tables, kept)
    built = KeywordIndex.build(tables.read("chunks"))
    tables.commit({"postings": built.postings, "lengths": built.lengths, "frequencies": built.frequencies}, {"chunker": CHUNKER_VERSION, "root": os.path.realpath(root)})
    print("files: " + ", ".join(f"{n} {s}" for s, n in sorted(counts.items())))
    print(markdown(walking.walk_report(rows.select("repo_id", "path", "reason")).orderBy(F.desc("files"), "reason")))
    return 0


def find(place: str, question: str, k: int) -> int:
    spark = _session()
    tables = VersionedTables(spark, place)
    if not tables.is_built():
        print(f"{place} holds no index", file=sys.stderr)
        return 2
    tables.check(chunker=CHUNKER_VERSION)
    asked = spark.createDataFrame([(1, question)], "query_id int, question string")
    chunks = tables.read("chunks")
    hits = search.hydrate(search.bm25(_keyword(tables), asked, 30), chunks).join(asked, "query_id")
    rows = search.penalise_paths(hits).where(F.col("rank") <= k)
    print(markdown(rows.orderBy("rank").select("rank", F.round("score", 4).alias("score"), location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("place"), "kind", "symbol")))
    return 0


def ask(place: str, question: str, provider: str, model: str) -> int:
    spark = _session()
    tables = VersionedTables(spark, place)
    if not tables.is_built():
        print(f"{place} holds no index", file=sys.stderr)
        return 2
    tables.check(chunker=CHUNKER_VERSION)
    retriever = Retriever.from_tables(tables, Settings(mode="keyword"))
    try:
        source = create_provider(provider, model, **({"reply": "See [1]."} if provider == "scripted" else {}))
        (row,) = Answerer(retriever, source).answer(spark.createDataFrame([(1, question)], "query_id int, question string")).collect()
    except (ProviderError, PermissionError) as e:
        print(e, file=sys.stderr)
        return 1
    print(row["clean_text"] or row["error"] or "No relevant code was found, so nothing was answered.")
    for n in row["cited"]:
        s = row["sources"][n - 1]
        print(f"[{n}] {s['path']}:{s['start_line']}-{s['end_line']}")
    return 0


def stats(place: str) -> int:
    tables = VersionedTables(_session(), place)
    state = tables.current()
    if not state:
        print(f"{place} holds no index", file=sys.stderr)
        return 2
    print(f"version {state['version']}, root {state['meta'].get('root')}")
    print(markdown(tables.read("chunks").groupBy("kind").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files")).orderBy("kind")))
    return 0


def show_chunks(file: str) -> int:
    if not os.path.isfile(file):
        print(f"{file} is no file", file=sys.stderr)
        return 2
    _, _, _, text, reason = load(file, os.path.basename(file))
    if reason:
        print(f"skipped: {reason}", file=sys.stderr)
        return 1
    ext = os.path.splitext(file)[1].lower()
    language = {**paths.CODE_EXTENSIONS, **paths.DOC_EXTENSIONS, **paths.CONFIG_EXTENSIONS}.get(ext)
    for p in chunk_text(text, language):
        print(f"{p.start + 1}-{p.end + 1}\t{p.kind}\t{p.symbol or ''}")
    return 0


def evaluate(place: str, file: str) -> int:
    spark = _session()
    tables = VersionedTables(spark, place)
    if not tables.is_built():
        print(f"{place} holds no index", file=sys.stderr)
        return 2
    questions = records.answerable(records.load_questions(spark, file)).withColumnRenamed("id", "query_id")
    hits = search.hydrate(search.bm25(_keyword(tables), questions, 30), tables.read("chunks").select("id", "path"))
    gold = questions.select("query_id", F.explode("gold_files").alias("path"))
    missing = [r["path"] for r in gold.join(tables.read("manifest").select("path"), "path", "left_anti").select("path").distinct().orderBy("path").limit(20).collect()]
    if missing:
        print("not in the index: " + ", ".join(missing), file=sys.stderr)
    ranks = metrics.gold_ranks(questions, search.ranked_files(hits), gold).join(questions.select("query_id", "type"), "query_id")
    print(markdown(metrics.ranking_report(ranks).orderBy("type")))
    print(markdown(metrics.misses(ranks).orderBy("query_id")))
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"index": ("root", "place"), "search": ("place", "question"), "ask": ("place", "question"), "stats": ("place",), "chunks": ("file",), "eval": ("place", "file")}.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
        if name == "search":
            sub.add_argument("-k", type=int, default=10)
        if name == "ask":
            sub.add_argument("--provider", default="server")
            sub.add_argument("--model", default="")
    got = parser.parse_args(arguments)
    try:
        if got.command == "index":
            return index(got.root, got.place)
        if got.command == "search":
            return find(got.place, got.question, got.k)
        if got.command == "ask":
            return ask(got.place, got.question, got.provider, got.model)
        if got.command == "stats":
            return stats(got.place)
        if got.command == "chunks":
            return show_chunks(got.file)
        return evaluate(got.place, got.file)
    except records.QuestionFileError as e:
        print(e, file=sys.stderr)
        return 2
    except IndexMismatchError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
