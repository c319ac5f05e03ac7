"""Identifier-aware tokens as column expressions inside the JVM, and the same of one word in Python for scans that count."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a word: letters, digits and the underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: The parts of a compound identifier.
PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"

# Left out of queries, never of the index (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")


def words(text: Column) -> Column:
    """The words of a text in order; null gives null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_tokens(word: Column) -> Column:
    """The tokens of one word: its parts in lower case, preceded by the whole word unless it has exactly one part.

    ``getUserById`` and ``get_user_by_id`` both give ``get user by id`` besides themselves; tokens of one character are dropped.
    """
    parts = F.transform(F.regexp_extract_all(word, F.lit(PART), F.lit(0)), lambda p: F.lower(p))
    whole = F.when(F.size(parts) != 1, F.array(F.lower(word))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(whole, parts), lambda t: F.length(t) > 1)


#: ``WORD`` and ``PART`` for Python, whose word characters differ from Java 17's only in those that Unicode took up later.
PYTHON_WORD, PYTHON_PART = re.compile(r"\w+"), re.compile(PART)


def tokens_of(word: str) -> list[str]:
    """What ``word_tokens`` gives, of a Python string."""
    parts = [p.lower() for p in PYTHON_PART.findall(word)]
    return [t for t in (parts if len(parts) == 1 else [word.lower(), *parts]) if len(t) > 1]


BYTES_PART = re.compile(PART.encode())


def ascii_tokens(word: bytes) -> list[bytes]:
    """``tokens_of`` a word of ASCII characters, in bytes."""
    parts = BYTES_PART.findall(word)
    return [t.lower() for t in (parts if len(parts) == 1 else (word, *parts)) if len(t) > 1]


#: Of each byte of a text: 0 no part of a word, 1 an underscore, 2 a digit, 4 a small letter, 8 a capital, 16 not ASCII.
KINDS = bytes(16 if c > 127 else 2 if chr(c).isdigit() else 4 if chr(c).islower() else 8 if chr(c).isupper() else c == ord("_") for c in range(256))
LOWER = bytes(range(256)).lower()
NO_WORD, NO_PART = (bytes(c for c in range(256) if KINDS[c] in kinds) for kinds in ((0, 16), (0, 1, 16)))


def text_tokens(texts: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``ascii_tokens`` of all words gives, for many texts at once: how many tokens each has, then of each token that is
    in ``asked`` the number of its text and its place there; last the numbers of texts that aren't ASCII, which have none here.

    Words and parts begin and end where the kind of character changes, so they are found by comparing all bytes with their
    neighbours.  Null counts as empty.
    """
    listed = [x or b"" for x in texts.to_pylist()]
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    starts = np.cumsum(sizes + 1) - sizes  # blanks around each text, so that none touches another
    data = b" ".join([b"", *listed, b""])
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    other = np.unique(np.searchsorted(starts, np.flatnonzero(kind == 16), "right") - 1)
    if len(other):
        for n in other:
            listed[n] = b" " * sizes[n]
        data = b" ".join([b"", *listed, b""])
        kind = np.frombuffer(data.translate(KINDS), np.uint8)

    word, part, capital, small = kind > 0, kind > 1, kind == 8, kind == 4
    begins = part.copy()  # a part begins where the byte before is of another kind, but for the small letters after a capital
    begins[1:] &= (kind[1:] != kind[:-1]) & ~(small[1:] & capital[:-1])
    begins[1:-1] |= capital[1:-1] & small[2:]
    word_at, word_end = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    part_at, part_end = np.flatnonzero(begins), np.flatnonzero(part[:-1] & (begins[1:] | ~part[1:])) + 1
    parts = np.diff(np.searchsorted(part_at, word_at), append=len(part_at))  # of each word

    def pieces(at: np.ndarray, end: np.ndarray, rest: bytes) -> pa.Array:
        cut = np.append(0, np.cumsum(end - at)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(data.translate(LOWER, rest))])

    found = pa.concat_arrays([pieces(word_at, word_end, NO_WORD), pieces(part_at, part_end, NO_PART)])
    place = pc.index_in(found, asked).fill_null(-1).to_numpy()  # at once, as the asked ones are read anew each time
    lengths, rows, places = np.zeros(len(listed), np.int64), [], []
    for at, valid, own in ((word_at, (word_end - word_at > 1) & (parts != 1), place[: len(word_at)]), (part_at, part_end - part_at > 1, place[len(word_at) :])):
        lengths += np.diff(np.append(0, np.cumsum(valid))[np.append(np.searchsorted(at, starts), len(at))])
        hit = np.flatnonzero(valid & (own >= 0))
        rows.append(np.searchsorted(starts, at[hit], "right") - 1)
        places.append(own[hit].astype(np.int64))
    return lengths, np.concatenate(rows), np.concatenate(places), other


def identifier_tokens(text: Column) -> Column:
    """All tokens of a text in order, repeated as often as they occur; for short texts (paths, symbols, questions)."""
    return F.flatten(F.transform(words(text), word_tokens))


def query_tokens(question: Column) -> Column:
    """Distinct tokens of a question in order, without stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(identifier_tokens(question), lambda t: ~F.array_contains(stop, t)))


def token_counts(df: DataFrame, key: str, text: Column, count: str = "tf") -> DataFrame:
    """``(key, term, count)`` of long texts: words are counted first and each different word is split only once.

    Splitting is the costly part, and a corpus has far fewer different words than words: they are grouped by (key, word) and
    the vocabulary is split apart and joined back.
    """
    by_word = df.select(key, F.explode(words(text)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    vocabulary = by_word.select("word").distinct().select("word", F.explode(word_tokens(F.col("word"))).alias("term"))
    return by_word.join(vocabulary, "word").groupBy(key, "term").agg(F.sum("n").alias(count))
