"""What is indexed and what changed: postings, document lengths, and the difference between a walk and the manifest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.identifiers import PYTHON_WORD, query_tokens, text_tokens, token_counts, tokens_of
from quillon.session import stored

#: Different words of other than ASCII texts whose tokens a task keeps; beyond them it begins anew.
KEPT_WORDS = 1 << 19
#: Bytes of texts whose tokens are found at a time, but for a longer text.
COUNTED_BYTES = 1 << 22
#: The columns of a document in a search: of each asked term in it the place in the vocabulary and its counts.
DOCUMENT = "length bigint, terms array<int>, tf_meta array<int>, tf_body array<int>"


def terms_of(questions: DataFrame) -> DataFrame:
    """``(query_id, term)``: what a question set asks for."""
    return questions.select("query_id", F.explode(query_tokens(F.col("question"))).alias("term"))


@dataclass
class KeywordIndex:
    """An inverted index as three tables; all of them are rebuilt or appended to, never changed in place."""

    postings: DataFrame  # term, id, tf_meta, tf_body
    lengths: DataFrame  # id, length: tokens of both columns
    frequencies: DataFrame  # term, df

    @staticmethod
    def build(chunks: DataFrame, keep: bool = True) -> "KeywordIndex":
        """From ``chunks(id, path, symbol, text)`` with unique ids; ``keep`` writes the postings so that they are made once."""
        meta = token_counts(chunks, "id", F.concat_ws(" ", "path", "symbol"), "tf_meta")
        body = token_counts(chunks, "id", F.col("text"), "tf_body")
        zero = F.lit(0).cast("long")
        both = meta.select("id", "term", "tf_meta", zero.alias("tf_body")).unionByName(body.select("id", "term", zero.alias("tf_meta"), "tf_body"))
        postings = both.groupBy("term", "id").agg(F.sum("tf_meta").alias("tf_meta"), F.sum("tf_body").alias("tf_body"))
        if keep:
            postings = stored(postings)
        lengths = postings.groupBy("id").agg(F.sum(F.col("tf_meta") + F.col("tf_body")).alias("length"))
        frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
        return KeywordIndex(postings, lengths, frequencies)

    def asked(self, terms: DataFrame) -> "AskedIndex":
        """The part of the index that the ``term`` column of ``terms`` needs, put together by document."""
        vocabulary = _vocabulary(terms)
        spark = self.postings.sparkSession
        numbers = spark.createDataFrame(list(enumerate(vocabulary)), "place int, term string")
        kept = self.postings.join(F.broadcast(numbers), "term").groupBy("id").agg(F.collect_list(F.struct("place", F.col("tf_meta").cast("int").alias("tf_meta"), F.col("tf_body").cast("int").alias("tf_body"))).alias("p"))
        none = F.array().cast("array<int>")
        column = lambda name: F.coalesce(F.col(f"p.{name}"), none)
        documents = self.lengths.select("id", F.col("length").cast("bigint").alias("length")).join(kept, "id", "left")
        return AskedIndex(documents.select("id", "length", column("place").alias("terms"), column("tf_meta").alias("tf_meta"), column("tf_body").alias("tf_body")), vocabulary)


def _vocabulary(terms: DataFrame) -> list[str]:
    return sorted(terms.select("term").distinct().toArrow().column("term").to_pylist())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64) // COUNTED_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(b)]
        yield from (b.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


@dataclass
class AskedIndex:
    """What a question set needs of an inverted index, a row per document, so that a task can score its documents alone.

    Every word of every text counts for the lengths; places and counts are kept of the asked terms only, so nothing is shuffled
    but those.
    """

    documents: DataFrame  # id and DOCUMENT
    vocabulary: list[str]

    @staticmethod
    def build(chunks: DataFrame, questions: DataFrame) -> "AskedIndex":
        """From ``chunks(id, path, symbol, text)``; of rows with the same id one counts, as whole as it is."""
        vocabulary = _vocabulary(terms_of(questions))
        held = chunks.sparkSession.sparkContext.broadcast({t.encode(): n for n, t in enumerate(vocabulary)})
        id_type = chunks.schema["id"].dataType.simpleString()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = held.value
            asked, known = pa.array(list(places), pa.binary()), {}  # known: word with other characters: how many tokens, which of them are asked for

            def plain(word: str) -> tuple[int, list[int]]:
                if (found := known.get(word)) is None:
                    if len(known) > KEPT_WORDS:
                        known.clear()
                    tokens = [t.encode() for t in tokens_of(word)]
                    found = known[word] = len(tokens), [places[t] for t in tokens if t in places]
                return found

            def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Tokens of each text; text and place of each that is asked for."""
                lengths, rows, at, other = text_tokens(texts, asked)
                more: list[tuple[int, int]] = []
                for n in other.tolist():
                    found = [plain(word) for word in PYTHON_WORD.findall(texts[n].as_py().decode())]
                    lengths[n] = sum(size for size, _ in found)
                    more += [(n, place) for _, own in found for place in own]
                if more:
                    more = np.array(more, np.int64)
                    rows, at = np.append(rows, more[:, 0]), np.append(at, more[:, 1])
                return lengths, rows, at

            for b in _pieces(batches):
                titles, texts = read(b.column("title")), read(b.column("text"))
                # sorted by text and place, those of the title first
                key = np.sort(np.concatenate([(rows * len(asked) + at) * 2 + n for n, (_, rows, at) in enumerate((titles, texts))]))
                first = np.flatnonzero(np.diff(key >> 1, prepend=-1))
                body = np.add.reduceat(key & 1, first) if len(first) else first
                tf = np.diff(first, append=len(key))
                rows, terms = np.divmod(key[first] >> 1, max(1, len(asked)))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(b)))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf - body, body)]
                yield pa.record_batch([b.column("id"), pa.array(titles[0] + texts[0]), *lists], ["id", "length", "terms", "tf_meta", "tf_body"])

        rows = chunks.where("id is not null").select("id", F.concat_ws(" ", "path", "symbol").cast("binary").alias("title"), F.col("text").cast("binary").alias("text"))
        documents = rows.mapInArrow(count, f"id {id_type}, {DOCUMENT}").where("length > 0")
        return AskedIndex(stored(documents.repartition("id").dropDuplicates(["id"])), vocabulary)  # few are repeated: they aren't sorted before they are sent

    def numbers(self) -> DataFrame:
        """``(place, term)`` of the vocabulary, to be sent to every task."""
        return F.broadcast(self.documents.sparkSession.createDataFrame(list(enumerate(self.vocabulary)), "place int, term string"))

    @property
    def postings(self) -> DataFrame:
        """``(term, id, tf_meta, tf_body)`` of the asked terms."""
        rows = self.documents.select("id", F.inline(F.arrays_zip("terms", "tf_meta", "tf_body")))
        return rows.join(self.numbers(), F.col("terms") == F.col("place")).select("term", "id", F.col("tf_meta").cast("bigint").alias("tf_meta"), F.col("tf_body").cast("bigint").alias("tf_body"))

    @property
    def frequencies(self) -> DataFrame:
        """``(term, df)`` of the asked terms."""
        counts = self.documents.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
        return counts.join(self.numbers(), "place").select("term", "df")


def manifest_of(files: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(*keys, file_hash, chunk_ids)``: one row per file with the sorted ids of its chunks."""
    ids = chunks.groupBy(*keys).agg(F.sort_array(F.collect_set("id")).alias("chunk_ids"))
    return files.select(*keys, "file_hash").join(ids, list(keys), "left").select(*keys, "file_hash", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def manifest_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path",), content: str = "file_hash") -> DataFrame:
    """``(*keys, status, old_hash, new_hash)`` with status new, changed, unchanged or removed; a full outer join on the keys."""
    a = old.select(*keys, F.col(content).alias("old_hash"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(content).alias("new_hash"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"), "old_hash", "new_hash")


def stale_ids(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path",), ids: str = "chunk_ids") -> DataFrame:
    """``(*keys, id)``: chunk ids of the old manifest that the new one no longer has for the same file."""
    before = old.select(*keys, F.explode(ids).alias("id"))
    return before.join(new.select(*keys, F.explode(ids).alias("id")), [*keys, "id"], "left_anti").distinct()


def run_report(diff: DataFrame) -> DataFrame:
    """One row with the number of files of each status."""
    names = ("new", "changed", "unchanged", "removed")
    return diff.agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def write_ahead(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(*keys, chunk_ids)``: the union of old and new ids of each file, which a run records before it changes anything."""
    both = old.select(*keys, F.col("chunk_ids").alias("a")).join(new.select(*keys, F.col("chunk_ids").alias("b")), list(keys), "full")
    none = F.array().cast("array<string>")
    return both.select(*keys, F.sort_array(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("chunk_ids"))


def outline(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "language", "kind", "symbol", "start_line", "end_line")


def file_heads(chunks: DataFrame) -> DataFrame:
    """``(repo_id, path, head)``: the text of the chunk that begins a file, the shortest if several do."""
    return chunks.where("start_line = 1").groupBy("repo_id", "path").agg(F.min_by("text", F.struct("end_line", "id")).alias("head"))
