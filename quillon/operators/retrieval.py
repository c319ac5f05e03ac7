"""The whole way from questions to numbered sources: rank, penalise, rerank, select, add headers, merge, and put a map before overviews."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.citations import citation_report
from quillon.functions.intents import overview_intent
from quillon.functions.text import context_budget, estimate_tokens
from quillon.operators import answering, search, selection
from quillon.operators.indexing import AskedIndex, KeywordIndex
from quillon.session import stored
from quillon.sources.settings import Settings


class RetrievalError(ValueError):
    """Settings that contradict each other, or a searcher that is missing."""


@dataclass
class Retriever:
    """Searches for any number of questions at once.

    ``chunks`` has ``id, path, language, kind, symbol, start_line, end_line, text``; ``vectors`` has ``id, embedding``.
    Questions are ``(query_id, question)`` and, for vector search, ``embedding``.
    """

    chunks: DataFrame
    keyword: KeywordIndex | AskedIndex | None = None
    vectors: DataFrame | None = None
    settings: Settings = Settings()
    reranker: Column | None = None  # an expression over the question and the chunk's columns

    def __post_init__(self) -> None:
        s = self.settings
        if s.mode not in ("vector", "keyword", "hybrid"):
            raise RetrievalError(f"unknown mode {s.mode!r}")
        if s.mode != "keyword" and self.vectors is None:
            raise RetrievalError(f"{s.mode} search needs vectors")
        if s.mode != "vector" and self.keyword is None:
            raise RetrievalError(f"{s.mode} search needs a keyword index")
        if min(s.top_k, s.max_chunks, s.max_chunks_per_file, s.context_budget) < 1 or s.keyword_weight < 0 or not (0 < s.test_penalty and 0 < s.changelog_penalty):
            raise RetrievalError("sizes and penalties must be positive")

    @staticmethod
    def from_tables(tables, settings: Settings = Settings(), reranker: Column | None = None) -> "Retriever":
        """A retriever over a stored index; raises where the mode needs a table that it has not."""
        if not tables.is_built():
            raise RetrievalError(f"{tables.root} holds no index")
        keyword = KeywordIndex(*(tables.read(n) for n in ("postings", "lengths", "frequencies"))) if tables.has("postings") else None
        return Retriever(tables.read("chunks"), keyword, tables.read("vectors") if tables.has("vectors") else None, settings, reranker)

    def rank(self, questions: DataFrame, only_paths: DataFrame | None = None) -> DataFrame:
        """``(query_id, question, id, score, rank, ...)`` with the chunks' columns.

        ``only_paths`` keeps the chunks of some files before the vector search takes its best; keyword search has no such filter.
        """
        s = self.settings
        if only_paths is not None and s.mode != "vector":
            raise RetrievalError("a file filter works in vector mode only")
        if s.mode == "vector":
            hits = self._vector(questions, only_paths)
        elif s.mode == "keyword":
            hits = search.bm25(self.keyword, questions, s.top_k)
        else:
            hits = search.hybrid(search.bm25(self.keyword, questions, s.top_k), self._vector(questions, None), s.keyword_weight).select("query_id", "id", "score", "rank")
        rows = search.hydrate(hits, self.chunks).join(questions.select("query_id", "question"), "query_id")
        rows = search.penalise_paths(rows, s.test_penalty, s.changelog_penalty)
        if self.reranker is not None:
            rows = search.rerank(rows, self.reranker, s.rerank_top)
            rows = search.penalise_paths(rows, s.test_penalty, s.changelog_penalty)
        return rows

    def _vector(self, questions: DataFrame, only_paths: DataFrame | None) -> DataFrame:
        only = None if only_paths is None else self.chunks.join(only_paths.select("path").distinct(), "path", "left_semi").select("id")
        return search.cosine(self.vectors, questions, self.settings.top_k, only=only, id_col="id")

    def retrieve(self, questions: DataFrame, only_paths: DataFrame | None = None) -> DataFrame:
        """``(query_id, path, language, start_line, end_line, text, symbols, kinds, score, rank, role, chunk_ids, tokens)``, spans that don't overlap."""
        s = self.settings
        ranked = stored(self.rank(questions, only_paths).withColumn("tokens", estimate_tokens(F.col("text"))))
        chosen = stored(selection.select_chunks(ranked, s.context_budget, s.max_chunks, s.max_chunks_per_file))
        detailed = chosen.join(ranked.select("query_id", "id", "kind", "symbol"), ["query_id", "id"])
        headers = selection.add_class_headers(detailed, self.chunks, s.context_budget)
        columns = ["path", "language", "kind", "symbol", "start_line", "end_line", "text"]
        mine = ranked.join(chosen.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "score", "rank", *columns).withColumn("context", F.lit(False))
        extra = headers.join(self.chunks.select("id", *columns), "id").select("query_id", "id", F.lit(0.0).alias("score"), "rank", *columns).withColumn("context", F.lit(True))
        spans = stored(mine.unionByName(extra).withColumn("end_line", F.coalesce("end_line", F.col("start_line") + F.size(F.split("text", "\n", -1)) - 1)))
        merged = selection.merge_spans(spans)
        language = spans.groupBy("query_id", "path").agg(F.min("language").alias("language"))
        out = merged.join(selection.merged_text(spans, merged), ["query_id", "path", "start_line"]).join(language, ["query_id", "path"])
        return out.withColumn("tokens", estimate_tokens(F.col("text")))

    def retrieve_overview(self, questions: DataFrame, map_text: str, readme: tuple[str, str] | None = None) -> DataFrame:
        """``retrieve``, with a map and the readme before the sources of questions about the whole repository.

        The sources of those questions then stop at the first that no longer fits; at least one stays.  A readme that is
        retrieved from its first line is not added again.
        """
        sources = stored(self.retrieve(questions))
        whole = questions.where(overview_intent(F.col("question")).isNotNull()).select("query_id")
        plain = sources.join(whole, "query_id", "left_anti").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.col("role") == "context", "path", "start_line")))
        front = [("(repository map)", "text", map_text, "map", 1)] + ([(readme[0], "markdown", readme[1], "readme", 2)] if readme else [])
        spark = questions.sparkSession
        head = spark.createDataFrame(front, "path string, language string, text string, role string, position int").crossJoin(whole)  # two rows for each
        if readme:
            there = sources.where((F.col("path") == readme[0]) & (F.col("start_line") == 1)).select("query_id", F.col("path").alias("path")).distinct()
            head = head.join(there, ["query_id", "path"], "left_anti")
        head = head.withColumn("tokens", estimate_tokens(F.col("text")))
        used = head.groupBy("query_id").agg(F.sum("tokens").alias("front"), F.max("position").alias("last"))
        order = Window.partitionBy("query_id").orderBy("rank", F.col("role") == "context", "path", "start_line")
        body = sources.join(used, "query_id").withColumns({"at": F.row_number().over(order), "running": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        body = body.where((F.col("at") == 1) | (F.col("running") + F.col("front") <= self.settings.context_budget)).withColumn("position", F.col("last") + F.col("at")).drop("at", "running", "front", "last")
        return plain.unionByName(body).unionByName(head.select("query_id", "path", "language", "text", "role", "position", "tokens"), allowMissingColumns=True)


ANSWER_SYSTEM = "Answer the question from the numbered sources alone and cite them like [1]. Say so where they do not hold the answer."


@dataclass
class Answerer:
    """Questions to cited answers: retrieval within the provider's room, one call per question, and what its citations amount to."""

    retriever: Retriever
    provider: answering.Provider
    max_tokens: int = 1_000
    consent: bool = False

    def answer(self, questions: DataFrame) -> DataFrame:
        """``(query_id, question, finish, error, reply, clean_text, cited, invalid, uncited, unverified_locations, grounded, validity, sources)``.

        A question for which nothing is found is answered with ``no_context`` and no call.
        """
        window = getattr(self.provider, "context_window", None)
        s = self.retriever.settings
        room = context_budget(F.lit(window).cast("long"), F.lit(s.context_budget), F.lit(self.max_tokens), F.lit(None).cast("int"))
        budget = int(questions.sparkSession.range(1).select(room.cast("long")).first()[0])
        sources = stored(replace(self.retriever, settings=replace(s, context_budget=budget)).retrieve(questions))
        blocks = questions.select("query_id", "question").join(answering.format_sources(sources), "query_id", "left")
        asked = blocks.withColumn("message", F.when(F.col("block").isNotNull(), answering.answer_message(F.col("block"), F.col("question"))))
        got = answering.complete(asked, self.provider, ["query_id", "question"], ANSWER_SYSTEM, max_tokens=self.max_tokens, consent=self.consent)
        order = F.struct("rank", (F.col("role") == "context").alias("last"), "path", "start_line", "end_line", "text", "role")
        spans = sources.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["path"].alias("path"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["text"].alias("text"), x["role"].alias("role"))).alias("sources"))
        both = stored(got.join(spans, "query_id", "left"))
        report = citation_report(both, "reply", "sources", ["query_id"])
        return both.select("query_id", "question", "finish", "error", "reply", "sources").join(report, "query_id")
