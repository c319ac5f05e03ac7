"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: A vocabulary of byte pairs as "token rank" lines; the path is a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the text is cut before pairs are merged; belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in pieces, cut before a single blank between words, where no token goes across.  Only a run of this
#: many characters without such a place is cut amid it, so one endless word can't take quadratic time.
LONG_TEXT = 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, longest: int = LONG_TEXT) -> Iterator[str]:
    """The text in pieces of up to ``longest`` characters that have the same tokens as the whole."""
    start = 0
    while len(text) - start > longest:
        at = start + longest
        while at > start and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace()):
            at = text.rfind(" ", start, at)
        at = at if at > start else start + longest
        yield text[start:at]
        start = at
    yield text[start:]


def with_token_counts(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            counts = [sum(len(encode(x)) for x in pieces(t)) if t else 0 for t in b.column(text_col).to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *([text_col] if text_col not in keep else [])).mapInArrow(run, f"{types}, n_tokens long")
