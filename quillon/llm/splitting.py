"""Splitting oversized items at natural boundaries by lexical cohesion.

Lines are compared in sliding blocks: the similarity of the words before and after each line break, smoothed by how far it
lies below the peaks on both sides, gives the depth of a valley, a likely change of topic.  Within the stretch of breaks that
keep a piece inside the limits and reasonably full, the deepest valley is cut; blank lines, lower indentation and headings
count as deeper.  A line that alone exceeds the limit is cut after a delimiter or blank.  Pieces are exact slices of the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_LINES, OVERLAP_LINES = 6_000, 120, 10
BLOCK = 6  # lines in each of the two blocks compared
FILL = 0.5  # a piece is at least this full, if it can be

_WORD = re.compile(r"[^\W\d_]{2,}|\d+")
_INLINE = (re.compile(r"[;}\])](?=[^\s;})\]])|[.!?](?=\s)"), re.compile(r"[,\s]"))


class Piece(NamedTuple):
    start: int  # offsets of the slice, in code points
    end: int
    start_line: int
    end_line: int
    natural: bool  # ends at a line break


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    dot = sum(c * b[w] for w, c in a.items() if w in b)
    return dot / math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))


def break_depths(lines: list[str]) -> list[float]:
    """For each line ``i`` how deep the cohesion valley just before it is; the first is 0.  Time grows with the number of words."""
    n = len(lines)
    words = [Counter(w.lower() for w in _WORD.findall(x)) for x in lines]
    similar = [1.0] * n
    before: Counter = Counter()
    after: Counter = Counter()
    for x in words[:BLOCK]:
        after.update(x)
    for i in range(1, n):
        before.update(words[i - 1])
        if i > BLOCK:
            before -= words[i - 1 - BLOCK]
        after -= words[i - 1]
        if i - 1 + BLOCK < n:
            after.update(words[i - 1 + BLOCK])
        similar[i] = _cosine(before, after)
    left, right = similar[:], similar[:]
    for i in range(1, n):  # the peak reached by climbing from i to the left, and to the right
        left[i] = max(similar[i], left[i - 1]) if similar[i - 1] >= similar[i] else similar[i]
    for i in range(n - 2, 0, -1):
        right[i] = max(similar[i], right[i + 1]) if similar[i + 1] >= similar[i] else similar[i]
    depth = [0.0] * n
    for i in range(1, n):
        d = (left[i] - similar[i]) + (right[i] - similar[i])
        here, above = lines[i], lines[i - 1]
        if not above.strip():
            d += 0.5
        if re.match(r"#{1,6} |(?:export |public |private |static |async )*(?:def|class|func|function|interface|type|struct|impl|fn)\b|@\w", here.lstrip()):
            d += 0.4
        if here.strip() and not here[0].isspace():
            d += 0.3
        elif here.strip() and len(here) - len(here.lstrip()) > len(above) - len(above.lstrip()) and above.strip():
            d -= 0.4
        if re.match(r"\s*[})\]]|\s*(?:else|elif|except|catch|finally)\b", here):
            d -= 0.5
        depth[i] = d
    return depth


def split(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap_lines: int = OVERLAP_LINES) -> list[Piece]:
    """Pieces of at most ``max_chars`` code points and ``max_lines`` lines that cover the text; one piece if it is within both.

    A piece starts ``overlap_lines`` lines before the end of the one before, fewer where those lines would fill more than a
    quarter of a piece or leave no room for the line after; after a cut inside a line the overlap is an eighth of ``max_chars``.
    """
    lines = text.split("\n")
    if len(lines) <= max_lines and len(text) <= max_chars:
        return [Piece(0, len(text), 0, len(lines) - 1, True)]
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    depth = break_depths(lines)
    overlap_lines = min(overlap_lines, max(0, max_lines // 2))
    pieces: list[Piece] = []
    start, line = 0, 0  # the next piece starts at this offset, in this line
    while True:
        last = line  # the last line that fits whole
        while last + 1 < len(lines) and last + 1 - line < max_lines and at[last + 2] - 1 - start <= max_chars:
            last += 1
        if at[last + 1] - 1 - start > max_chars:  # what is left of this line is too long
            end = _inline_cut(text, start, start + max_chars)
            pieces.append(Piece(start, end, line, line, False))
            start = max(end - max_chars // 8, start + 1)
            continue
        if last == len(lines) - 1:
            pieces.append(Piece(start, len(text), line, last, True))
            return pieces
        full = at[last + 1] - start
        least = line + 1
        floor = pieces[-1].end if pieces else 0
        while least < last + 1 and (at[least] - start < FILL * full or at[least] <= floor + 1):
            least += 1
        cut = max(range(least, last + 2), key=lambda i: (depth[i], i))  # the piece ends before line ``cut``
        pieces.append(Piece(start, at[cut] - 1, line, cut - 1, True))
        back = cut
        # an overlap leaves room for the next line at least, so that every piece goes further than the one before
        while cut - back < overlap_lines and back - 1 > line and at[cut] - at[back - 1] <= max_chars // 4 and at[cut + 1] - 1 - at[back - 1] <= max_chars:
            back -= 1
        start, line = at[back], back


def _inline_cut(text: str, low: int, high: int) -> int:
    for pattern in _INLINE:
        ends = [m.end() for m in pattern.finditer(text, low + (high - low) * 3 // 4, high)]
        if ends:
            return ends[-1]
    return high


def oversized(text, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES):
    """Whether a text column exceeds a limit: code points, or line feeds plus one."""
    return (F.length(text) > max_chars) | (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1 > max_lines)


def split_oversized(
    df: DataFrame, id_col: str = "id", text_col: str = "text", line_col: str | None = "start_line", max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap_lines: int = OVERLAP_LINES
) -> DataFrame:
    """``(id, piece, pieces, start_line, end_line, start_char, end_char, text)`` for the rows over a limit; others give no rows.

    ``start_line`` counts from the row's own first line (1 where null).  Repeated rows give their pieces once.  Null and empty
    texts are never over a limit.  Only oversized rows leave the JVM.
    """
    first = F.coalesce(F.col(line_col), F.lit(1)) if line_col else F.lit(1)
    rows = df.select(F.col(id_col).alias("id"), first.cast("int").alias("first"), F.col(text_col).alias("text")).where(oversized(F.col("text"), max_chars, max_lines)).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, base, text in b.itertuples(index=False):
                parts = split(text, max_chars, max_lines, overlap_lines)
                out += [(i, k, len(parts), base + p.start_line, base + p.end_line, p.start, p.end, text[p.start : p.end]) for k, p in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=["id", "piece", "pieces", "start_line", "end_line", "start_char", "end_char", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, piece int, pieces int, start_line int, end_line int, start_char int, end_char int, text string")
