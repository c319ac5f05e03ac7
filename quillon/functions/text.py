"""Small text expressions: estimates, labels, identifiers, clipping, fences and spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def location(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def embed_text(path: Column, symbol: Column, kind: Column, text: Column) -> Column:
    """The text that is embedded: a header of the parts that are there, then the chunk."""
    empty = lambda c: F.when(c != "", c)
    return F.concat(F.concat_ws(" • ", empty(path), empty(symbol), empty(kind)), F.lit("\n"), text)


def chunk_id(repo_id: Column, path: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", repo_id, path, start.cast("string"), end.cast("string"), F.sha1(text)))


def repo_key(name: Column, root: Column) -> Column:
    """A readable key of a repository: its name without unusual characters, and a short hash of where it lies."""
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "-"), F.lit("-"), F.substring(F.sha1(root), 1, 8))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut and end with an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def code_fence(text: Column) -> Column:
    """Backticks enough that no run inside the text closes the fence: three, or one more than the longest run."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    longer = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.when(~F.contains(text, F.lit("```")), F.lit("```")).otherwise(longer)  # most texts have no such run


def safe_cell(text: Column) -> Column:
    """A leading apostrophe for what a spreadsheet would run as a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), text)).otherwise(text)


def clean_rewrite(reply: Column) -> Column:
    """The first line with text of a model's rewriting, without a label or quotes."""
    lines = F.filter(F.transform(F.split(reply, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    bare = F.regexp_replace(first, r"(?i)^(?:standalone|rewritten|new)?\s*question\s*:\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(bare), "^[\"'`]+", ""), "[\"'`]+$", ""))


def symbol_parent(symbol: Column) -> Column:
    """``A.B`` for ``A.B.c``; null without a dot."""
    return F.when(F.instr(symbol, ".") > 0, F.regexp_extract(symbol, r"^(.*)\.", 1))


def symbol_leaf(symbol: Column) -> Column:
    return F.substring_index(symbol, ".", -1)


def whole_word(name: Column) -> Column:
    """A pattern that finds a name standing alone; dollar signs are part of names."""
    return F.concat(F.lit(r"(?<![\w$])\Q"), name, F.lit(r"\E(?![\w$])"))


def context_budget(window: Column, requested: Column, max_tokens: Column, output_cap: Column, overhead: int = 1500, safety: float = 1.4) -> Column:
    """Tokens of code that fit a prompt: the request, unless the window, less the answer and an overhead, holds less; at least 1,000."""
    reserve = F.least(max_tokens, F.coalesce(output_cap, max_tokens))
    room = F.floor((window - reserve - overhead) / safety)
    return F.when(window.isNull(), requested).otherwise(F.greatest(F.lit(1000), F.least(requested, room)))


def model_size(tag: Column) -> Column:
    """Billions of parameters named in a model's tag; null if none is."""
    found = F.regexp_extract(F.substring_index(tag, ":", -1), r"(\d+(?:\.\d+)?)b", 1)
    return F.when(found != "", found.cast("double"))


def model_family(tag: Column) -> Column:
    return F.regexp_extract(F.lower(tag), "^[a-z]+", 0)


# Forms of addresses that are accepted for cloning, and what makes one unsafe (fixed values).
_HTTPS = r"^https://[A-Za-z0-9.-]+(?::\d+)?/[A-Za-z0-9._~/-]+$"
_SSH = r"^ssh://(?:[A-Za-z0-9._-]+@)?[A-Za-z0-9.-]+(?::\d+)?/[A-Za-z0-9._~/-]+$"
_SCP = r"^[A-Za-z0-9._-]+@[A-Za-z0-9.-]+:[A-Za-z0-9._~][A-Za-z0-9._~/-]*$"


def is_git_url(url: Column) -> Column:
    """A plain https, ssh or scp-like address: no credentials in https, no blanks, no leading dash, no climbing path."""
    shape = url.rlike(_HTTPS) | url.rlike(_SSH) | url.rlike(_SCP)
    return F.coalesce(shape & ~url.startswith("-") & ~url.contains("..") & ~url.rlike(r"\s"), F.lit(False))


def git_repo_name(url: Column) -> Column:
    """The last part of an address without ``.git``."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/:]+)$", 1), r"\.git$", "")


def escape_math(text: Column) -> Column:
    """Dollar signs outside code spans and blocks escaped, so that a renderer doesn't read them as formulas."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```|`[^`\n]*`|[^`]+|`"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`") & (F.length(p) > 1), p).otherwise(F.replace(p, F.lit("$"), F.lit("\\$")))), "")
