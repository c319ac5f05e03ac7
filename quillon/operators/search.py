"""Ranked search over question sets: BM25, exact cosine, rank fusion, path penalties and reranking.

Every operator takes all questions at once and is keyed by ``query_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.identifiers import query_tokens
from quillon.operators.indexing import AskedIndex, KeywordIndex, terms_of
from quillon.session import stored

K1, B, META_WEIGHT, BODY_WEIGHT = 1.2, 0.75, 4.0, 1.0
RRF_K = 60
DIGITS = 6  # scores are rounded before ranking, so ties do not hang on the order of summation
#: Numbers of queries' vectors held by one task (8 bytes each); more queries are searched in several passes.
QUERY_CELLS = 1 << 23
#: Terms of questions that are scored in one pass over the documents, under 100 bytes each.
SENT_TERMS = 1 << 19
#: Terms of documents that a task scores at a time, under 100 bytes each.
BLOCK_TERMS = 1 << 20
#: A term that is in over one of so many documents of a block has a number for each of them, 8 x ``WIDE`` bytes a term at most.
WIDE = 8
#: How much more it costs to send a row of the best than to read a document's term once more, about.
SENT_COST = 100
#: Ids that are sent to every task by their hashes, under 100 bytes each.
SENT_IDS = 1 << 20
#: Queries that are multiplied with a block of vectors at a time, numbers of such a block, and pairs worked out exactly at a time.
QUERY_TILE, VECTOR_CELLS, EXACT_PAIRS = 256, 1 << 20, 1 << 13


def top_k(hits: DataFrame, k: int, by: Sequence[Column], key: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``; a window limit, so each task keeps ``k`` per query."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(index: KeywordIndex | AskedIndex, queries: DataFrame, k: int = 30) -> DataFrame:
    """``(query_id, id, score, rank)`` of ``queries(query_id, question)``; no tokens or ``k <= 0`` give no rows.

    A term found in the path or symbol counts four times one in the text.  Each task scores its documents against all questions
    and keeps its best ``k``, ties included, so only those are shuffled.  Questions of over ``SENT_TERMS`` terms go in passes.
    Many questions are divided among tasks too, which then read more of the documents each and send fewer rows.
    """
    terms = terms_of(queries)
    total = terms.count()
    asked = index if isinstance(index, AskedIndex) else index.asked(terms)
    id_type, query_type = asked.documents.schema["id"].dataType.simpleString(), terms.schema["query_id"].dataType.simpleString()
    if not total or k < 1:
        return asked.documents.select(F.lit(None).cast(query_type).alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if not isinstance(index, AskedIndex):
        asked = AskedIndex(stored(asked.documents), asked.vocabulary)
    size = asked.documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum(F.size("terms")).alias("terms")).first()
    df = np.zeros(len(asked.vocabulary))
    counts = asked.documents.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("df")).toArrow()  # a row per asked term
    df[counts.column("place").to_numpy()] = counts.column("df").to_numpy()
    odds = np.log((size["n"] - df + 0.5) / (df + 0.5))
    idf = np.where(odds > 0, odds, 1e-6)
    places = pa.array(asked.vocabulary, pa.string())
    passes = -(-total // SENT_TERMS)
    context = queries.sparkSession.sparkContext
    tasks = 2 * context.defaultParallelism  # a task sends its best once, however much it reads
    weights = context.broadcast((idf, size["mean"]))

    def one(part: DataFrame) -> list[DataFrame]:
        rows = part.toArrow()
        names = rows.column("query_id").combine_chunks().dictionary_encode("encode")
        who, what = names.indices.to_numpy(zero_copy_only=False), pc.index_in(rows.column("term"), places)
        if what.null_count:
            raise ValueError("the index was made for other questions: it lacks terms of these")
        what, count = what.to_numpy(), len(names.dictionary)
        order = np.lexsort((-idf[what], who))  # the rarest terms of a question first
        who, what = who[order], what[order]
        # more groups of questions send fewer rows and read the documents more often
        best = np.sqrt(tasks * count * passes * k * SENT_COST / max(1, size["terms"] or 0))
        parts = max(2, round(tasks / max(1, best)))  # a union of single partitions would be one task
        groups = min(count, -(-tasks // (parts * passes)))
        documents = asked.documents.coalesce(max(2, round(tasks / max(1, groups * passes))))
        found = []
        for group in range(groups):
            own = who % groups == group
            mine = np.arange(group, count, groups)
            held = context.broadcast((names.dictionary.take(pa.array(mine)), np.searchsorted(who[own] // groups, np.arange(len(mine) + 1)), what[own]))
            found.append(_ranked_by_task(documents, held, weights, k, id_type, query_type))
        return found

    parts = [x for p in range(passes) for x in one(terms if passes == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p))]
    return top_k(reduce(DataFrame.unionByName, parts), k, [F.desc("score"), F.asc("id")]).select("query_id", "id", "score", "rank")


def _ranked_by_task(documents: DataFrame, held, weights, k: int, id_type: str, query_type: str) -> DataFrame:
    """``(query_id, id, score)``: the best ``k`` of each question in each task."""
    margin = 10.0**-DIGITS  # what rounding can move

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, starts, what), (idf, mean) = held.value, weights.value
        best = _Best(k, pa.string() if id_type == "string" else pa.int64())
        least = np.full(len(names), -np.inf)  # below it a document is none of the best k
        for ids, length, sizes, term, tf in _blocks(batches):
            # documents are numbered by their ids' order, postings lie by term and document
            place = np.empty(len(ids), np.int64)
            order = np.asarray(pc.sort_indices(ids))
            place[order] = np.arange(len(ids))
            ids = ids.take(pa.array(order))
            doc = np.repeat(np.arange(len(place)), sizes)
            part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            key = np.argsort(term * np.int64(len(place)) + place[doc])
            term, doc, part = term[key], place[doc[key]], part[key]
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
            size = np.diff(ends)
            most = np.zeros(len(idf))
            there = np.flatnonzero(size)
            if len(there):
                most[there] = np.maximum.reduceat(part, ends[there])
            # terms of many documents have a row of all; they are added up once for all questions that ask for the same of them
            wide = np.flatnonzero(size * WIDE > len(ids))
            row = np.full(len(idf), -1)
            row[wide] = np.arange(len(wide))
            rows = np.zeros((len(wide), len(ids)))
            for n, t in enumerate(wide):
                rows[n, doc[ends[t] : ends[t + 1]]] = part[ends[t] : ends[t + 1]]
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def keep(q: int, at: np.ndarray, found: np.ndarray) -> None:
                if len(at) > k:
                    near = found > np.partition(found, len(at) - k)[len(at) - k] - margin  # before they are rounded
                    at, found = at[near], found[near]
                    if len(at) > 2 * k:  # many ties
                        order = np.argsort(-np.round(found, DIGITS), kind="stable")[:k]
                        at, found = at[order], found[order]
                if len(at):
                    kept.append((np.full(len(at), q), at, found))

            # of each question's terms those of many documents and those of few, and the most that either can give
            floors, at_row, peak = np.maximum(0.0, least), row[what], most[what]
            many, some = at_row >= 0, (at_row < 0) & (size[what] > 0)
            tops, rests = (np.add.reduceat(np.where(x, peak, 0.0), starts[:-1]) for x in (many, some))
            cut_many, cut_some = (np.append(0, np.cumsum(x))[starts].tolist() for x in (many, some))
            wanted, own = at_row[many], what[some]
            spans_of = [slice(*x) for x in zip(ends[own].tolist(), ends[own + 1].tolist())]
            alike: dict[bytes, list[tuple[int, list[slice], float]]] = {}
            score = np.zeros(len(ids))
            for q in np.flatnonzero(tops + rests > floors).tolist():
                mine, spans = np.sort(wanted[cut_many[q] : cut_many[q + 1]]), spans_of[cut_some[q] : cut_some[q + 1]]
                floor, top = floors[q], tops[q]
                if top > floor:
                    alike.setdefault(mine.tobytes(), []).append((q, spans, rests[q]))
                    continue
                # only documents with a term of few can be among the best
                if len(spans) == 1:
                    at, found = doc[spans[0]], part[spans[0]]
                    near = found > floor - top
                    at, found = at[near], found[near]
                else:
                    for x in spans:
                        score[doc[x]] += part[x]
                    at = np.concatenate([doc[x] for x in spans])
                    near = np.sort(at[score[at] > floor - top])
                    near = near[np.append(True, near[1:] != near[:-1])] if len(near) else near
                    found = score[near]
                    score[at] = 0
                    at = near
                if len(at):
                    if len(mine):
                        base = np.zeros(len(at))
                        for n in mine:
                            base += rows[n, at]
                        found = found + base
                    near = found > floor
                    keep(q, at[near], found[near])
            for q, spans, rest, base, top in _by_wide(alike, rows):
                floor = floors[q]
                if top + rest <= floor:
                    continue
                for x in spans:
                    score[doc[x]] += part[x]
                if top <= floor and spans:
                    at = np.concatenate([doc[x] for x in spans])
                    near = np.sort(at[score[at] + base[at] > floor])
                    near = near[np.append(True, near[1:] != near[:-1])] if len(near) else near
                    found = score[near] + base[near]
                    score[at] = 0
                    at = near
                else:
                    whole = score + base
                    at = np.flatnonzero(whole > floor)
                    found = whole[at]
                    for x in spans:
                        score[doc[x]] = 0
                keep(q, at, found)
            if kept:
                best.add(ids, np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), np.round(np.concatenate([x[2] for x in kept]), DIGITS))
                best.trim()
                full = best.full(len(names))
                least[best.who[full]] = best.score[full] - margin
        if len(best.who):
            yield pa.record_batch([names.take(pa.array(best.who)), best.ids.take(pa.array(best.at)), pa.array(best.score)], ["query_id", "id", "score"])

    kind = "string" if id_type == "string" else "long"
    return documents.mapInArrow(search, f"query_id {query_type}, id {kind}, score double").withColumn("id", F.col("id").cast(id_type))


def _by_wide(alike: dict[bytes, list[tuple[int, list[slice], float]]], rows: np.ndarray) -> Iterator[tuple[int, list[slice], float, np.ndarray, float]]:
    """Questions and their other terms, with the sum of the rows that they ask for and its maximum."""
    for of, asked in alike.items():
        base = np.zeros(rows.shape[1])
        for n in np.frombuffer(of, np.int64):
            base += rows[n]
        top = base.max(initial=0.0)
        for q, spans, rest in asked:
            yield q, spans, rest, base, top


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Documents of at least ``BLOCK_TERMS`` terms at a time: ids, lengths, terms of each, places of all terms and their weighted counts.

    The first block is smaller, as all of its terms are added up: only then is it known what the best are at least.
    """
    held: list[pa.RecordBatch] = []
    size, most = 0, BLOCK_TERMS // 8

    def flush() -> tuple:
        whole = pa.Table.from_batches(held).combine_chunks()
        term, meta, body = (whole.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "tf_meta", "tf_body"))
        return whole.column("id").combine_chunks(), whole.column("length").to_numpy(), pc.list_value_length(whole.column("terms")).to_numpy(), term, META_WEIGHT * meta + BODY_WEIGHT * body

    for b in (whole.slice(lo, 2048) for whole in batches for lo in range(0, len(whole), 2048)):
        held.append(b)
        size += len(b.column("terms").flatten())
        if size >= most:
            yield flush()
            held, size, most = [], 0, BLOCK_TERMS
    if sum(len(b) for b in held):
        yield flush()


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, only: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", text_col: str = "", embedder=None) -> DataFrame:
    """Exact cosine top ``k``: ``(query_id, id, score, rank)``; ``only`` keeps the vectors of some ids before the search.

    With an ``embedder`` that has ``vectors``, the rows have texts in ``text_col`` instead, which become vectors in the task that
    searches them; null counts as an empty text.

    Each task multiplies its vectors with the queries, tile by tile, in single precision.  Only pairs that could be among the
    best by the error this can have are worked out exactly; it keeps its best ``k`` per query, so only those are shuffled.
    Queries beyond ``QUERY_CELLS`` numbers go in passes.  A zero vector has similarity 0.
    """
    value = F.col(vector_col) if embedder is None else F.coalesce(text_col, F.lit(""))
    base = vectors.select(F.col(id_col).alias("id"), value.alias("v")).where("v is not null")
    matrix_of = _matrix if embedder is None else lambda texts: embedder.vectors(texts.to_pylist())
    if only is not None:
        base = base.join(only.select(F.col(only.columns[0]).alias("id")).distinct(), "id", "left_semi")
    wanted = queries.select(F.col("query_id"), F.col(vector_col).alias("v")).where("v is not null")
    size = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"] or k < 1:
        return base.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    passes = max(1, -(-size["n"] * max(size["d"], k) // QUERY_CELLS))
    id_type, query_type = base.schema["id"].dataType.simpleString(), wanted.schema["query_id"].dataType.simpleString()

    def one(part: DataFrame) -> DataFrame:
        rows = part.toArrow()
        matrix = _unit(_matrix(rows.column("v"))) if rows.num_rows else np.zeros((0, size["d"]))
        held = base.sparkSession.sparkContext.broadcast((rows.column("query_id").combine_chunks(), matrix))  # at most QUERY_CELLS numbers

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            single = q.astype(np.float32)
            # what single precision and rounding can move the product of two unit vectors
            margin = (q.shape[1] + 8) * 2.0**-23 + 10.0**-DIGITS
            least = np.full(len(q), -np.inf)
            best = _Best(k, pa.string() if id_type == "string" else pa.int64())
            for ids, rows in _vector_blocks(batches, matrix_of) if len(q) else ():
                v = _unit(rows)
                one = v.astype(np.float32)
                for lo in range(0, len(q), QUERY_TILE):
                    near = single[lo : lo + QUERY_TILE] @ one.T
                    floor = least[lo : lo + QUERY_TILE] - margin
                    if near.shape[1] > k and np.isinf(floor).any():  # nothing is known yet: at least k are as near as this
                        floor = np.maximum(floor, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 2 * margin)
                    who, at = np.divmod(np.flatnonzero(near >= floor[:, None].astype(np.float32) - np.float32(2.0**-22)), near.shape[1])  # faster than by two axes
                    for a in range(0, len(who), EXACT_PAIRS):
                        w, x = who[a : a + EXACT_PAIRS] + lo, at[a : a + EXACT_PAIRS]
                        best.add(ids, w, x, np.round(np.einsum("ij,ij->i", q[w], v[x]), DIGITS))
                        if best.waiting >= max(len(q) * k, 1 << 20):  # many ties
                            best.trim()
                if best.waiting >= len(q) * k or np.isinf(least).any():
                    best.trim()
                    full = best.full(len(q))
                    least[best.who[full]] = best.score[full]
            best.trim()
            if len(best.who):
                yield pa.record_batch([names.take(pa.array(best.who)), best.ids.take(pa.array(best.at)), pa.array(best.score)], ["query_id", "id", "score"])

        # a task sends its best once, however much it reads; passes run beside each other
        few = base.coalesce(max(2, -(-2 * base.sparkSession.sparkContext.defaultParallelism // passes)))
        return few.mapInArrow(search, f"query_id {query_type}, id {'string' if id_type == 'string' else 'long'}, score double").withColumn("id", F.col("id").cast(id_type))

    parts = [one(wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)) for p in range(passes)]
    return top_k(reduce(DataFrame.unionByName, parts), k, [F.desc("score"), F.asc("id")]).select("query_id", "id", "score", "rank")


class _Best:
    """The ``k`` best of each query among all pairs added, equal scores by the lower id."""

    def __init__(self, k: int, id_type: pa.DataType):
        self.k, self.ids, self.waiting = k, pa.array([], id_type), 0
        self.who, self.at, self.score = np.array([], np.int64), np.array([], np.int64), np.array([])
        self._added: list[tuple] = []

    def add(self, ids: pa.Array, who: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        used, at = np.unique(at, return_inverse=True)
        self._added.append((ids.cast(self.ids.type).take(pa.array(used)), who, at, score))
        self.waiting += len(who)

    def trim(self) -> None:
        starts = np.cumsum([len(self.ids), *(len(x[0]) for x in self._added)])
        ids = pa.concat_arrays([self.ids, *(x[0] for x in self._added)])
        who = np.concatenate([self.who, *(x[1] for x in self._added)])
        at = np.concatenate([self.at, *(x[2] + s for x, s in zip(self._added, starts))])
        score = np.concatenate([self.score, *(x[3] for x in self._added)])
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        order = np.lexsort((place[at], -score, who))
        who, at, score = who[order], at[order], score[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        used, at = np.unique(at[kept], return_inverse=True)
        self.who, self.at, self.score, self.ids = who[kept], at, score[kept], ids.take(pa.array(used))
        self._added, self.waiting = [], 0

    def full(self, queries: int) -> np.ndarray:
        """Where the ``k``-th of each query stands that has so many, once trimmed."""
        last = np.flatnonzero(np.append(self.who[1:] != self.who[:-1], True)) if len(self.who) else np.array([], np.int64)
        return last[np.bincount(self.who, minlength=queries)[self.who[last]] == self.k]


def _vector_blocks(batches: Iterator[pa.RecordBatch], matrix_of: Callable[[pa.Array], np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors, about ``VECTOR_CELLS`` numbers at a time, whatever the size of the batches."""
    ids, rows, cells = [], [], 0
    for b in (whole.slice(lo, 1024) for whole in batches for lo in range(0, len(whole), 1024)):
        m = matrix_of(b.column("v"))
        step = max(1, VECTOR_CELLS // max(1, m.shape[1]))
        for lo in range(0, len(m), step):
            ids.append(b.column("id").slice(lo, step))
            rows.append(m[lo : lo + step])
            cells += rows[-1].size
            if cells >= VECTOR_CELLS:
                yield pa.concat_arrays(ids), np.concatenate(rows)
                ids, rows, cells = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), np.concatenate(rows)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fuse(rankings: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(query_id, id, rank)`` lists: ``(query_id, id, score, best, rank)``.

    An id listed twice counts once, at its first place, and takes up no second rank.  Ties go to the better single rank, then
    the id.
    """
    weights = list(weights or [1.0] * len(rankings))
    if not rankings or len(weights) != len(rankings):
        raise ValueError("one weight of at least 0 per ranking, and k of at least 1")
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank", F.lit(n).alias("list")) for n, r in enumerate(rankings)])
    return fuse_lists(rows, [weights], k).select("query_id", "id", "score", "best", "rank")


def fuse_lists(rows: DataFrame, weightings: Sequence[Sequence[float]], k: int = RRF_K, keep: Sequence[str] = ()) -> DataFrame:
    """``fuse`` under several weightings at once: ``(query_id, id, weighting, score, best, *keep, rank)`` of ``(query_id, id, rank, list)``.

    A weighting has the weights of lists 0, 1 and so on; places are worked out once for all of them.  ``keep`` names columns that
    the query and the id determine.
    """
    if k < 1 or any(w < 0 for ws in weightings for w in ws):
        raise ValueError("one weight of at least 0 per ranking, and k of at least 1")
    kept = [F.first(c).alias(c) for c in keep]
    once = rows.groupBy("query_id", "list", "id").agg(F.min("rank").alias("at"), *kept)
    place = F.row_number().over(Window.partitionBy("query_id", "list").orderBy("at", "id"))
    each = F.array(*[F.struct(F.lit(n).alias("weighting"), F.array(*[F.lit(float(w)) for w in ws]).alias("weights")) for n, ws in enumerate(weightings)])
    placed = once.select("query_id", "id", "list", *keep, place.alias("place")).select("query_id", "id", "list", *keep, "place", F.inline(each)).withColumn("weight", F.get("weights", F.col("list")))
    fused = placed.groupBy("query_id", "weighting", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("place"))), 9).alias("score"), F.min("place").alias("best"), *kept)
    rank = F.row_number().over(Window.partitionBy("query_id", "weighting").orderBy(F.desc("score"), "best", "id"))
    return fused.withColumn("rank", rank)


def penalise_paths(ranked: DataFrame, test_penalty: float = 0.5, changelog_penalty: float = 1.0) -> DataFrame:
    """Scores lowered for tests and release notes unless the question is about them; ranks anew, ties keep their order.

    ``ranked`` has ``query_id, question, id, path, score, rank``.  A penalty of 1 or more is off; tests take precedence.
    """
    tests = F.lit(test_penalty < 1.0) & ~paths.mentions_tests(F.col("question")) & paths.is_test_path(F.col("path"))
    notes = F.lit(changelog_penalty < 1.0) & ~paths.mentions_changes(F.col("question")) & paths.is_changelog_path(F.col("path"))
    return penalise(ranked, F.when(tests, test_penalty).when(notes, changelog_penalty).otherwise(1.0))


def penalise(ranked: DataFrame, factor: Column, *key: str) -> DataFrame:
    """Scores lowered to ``factor`` of what is above or below 0, and ranks anew within the query and ``key``; ties keep their order."""
    lowered = ranked.withColumn("score", F.round(F.col("score") - F.abs("score") * (1.0 - factor), 9)).withColumnRenamed("rank", "before")
    order = Window.partitionBy("query_id", *key).orderBy(F.desc("score"), "before")
    return lowered.withColumn("rank", F.row_number().over(order)).drop("before")


def rerank(ranked: DataFrame, score: Column, head: int = 30) -> DataFrame:
    """The first ``head`` of each query by a new score, the rest below them in their order; lists under two stay as they are."""
    size = F.count("*").over(Window.partitionBy("query_id"))
    marked = ranked.withColumns({"before": F.col("rank"), "size": size, "fresh": score})
    inside = (F.col("before") <= head) & (F.col("size") >= 2)
    floor = F.min(F.when(inside, F.col("fresh"))).over(Window.partitionBy("query_id"))
    value = F.when(F.col("size") < 2, F.col("score")).when(inside, F.col("fresh")).otherwise(F.round(F.col("floor") - (F.col("before") - head) * 1e-6, 9))
    out = marked.withColumn("floor", floor).withColumn("score", value)
    order = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.desc("score"), "before")
    return out.withColumn("rank", F.row_number().over(order)).drop("before", "size", "fresh", "floor")


def overlap_score(question: Column, text: Column) -> Column:
    """A reranking score without a model: the share of the question's tokens that the text's words contain."""
    wanted = query_tokens(question)
    have = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.lower(w)))
    return F.round(F.size(F.array_intersect(wanted, have)) / F.greatest(F.lit(1), F.size(wanted)), DIGITS)


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks; hits of unknown chunks are dropped, ranks stay."""
    return hits.join(chunks, "id")


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``id`` isn't in ``ids``, for a join that is to move few of them.

    Hashes of up to ``SENT_IDS`` ids, as ``ids`` counts them, are sent to every task; with more of them all rows are left.
    ``ids`` should be cheap to read again.
    """
    if ids.count() > SENT_IDS:
        return rows
    return rows.join(F.broadcast(ids.select(F.xxhash64("id").alias("_hash"))), F.xxhash64(rows["id"]) == F.col("_hash"), "left_semi")


def ranked_files(ranked: DataFrame) -> DataFrame:
    """``(query_id, path, chunk_rank, rank)``: files by the place of their first chunk."""
    first = ranked.groupBy("query_id", "path").agg(F.min("rank").alias("chunk_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_rank", "path")))


def hybrid(keyword: DataFrame, vector: DataFrame, keyword_weight: float = 1.0) -> DataFrame:
    """Both searchers' lists fused, the vector list with weight 1."""
    return fuse([vector, keyword], [1.0, keyword_weight])
