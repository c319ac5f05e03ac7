"""Files that nobody wrote by hand: generated, minified, vendored or data saved as code.

Vendored copies are found by their content.  The normalised token stream of each code file is hashed in runs of ``GRAM``
tokens and winnowed: of every ``WINDOW`` consecutive hashes the smallest is a fingerprint.  Two files are alike when the
fingerprints of both are those of either to ``LEAST_ALIKE`` or more.  A file is a common origin when the files like it, its own
copies included, lie in ``LEAST_REPOS`` or more repositories; a file is vendored when it is like one common origin.  So edited
copies are found, and files put together from functions that come from several places are not.  A file of fewer than
``LEAST_PRINTS`` fingerprints is like those with the same tokens throughout, if it has ``LEAST_TOKENS`` of them: shorter ones (an
empty package, an import) are the same by chance.  No name, place or notice takes part in this.  Copies that recur nowhere can't
be told by recurrence; those that say what they are get a reason of their own, ``third_party``.

Files with the same fingerprints form one class; the join of classes is the exact one of ``near_duplicates``.  Of each class
only ``LEAST_REPOS`` repositories are carried on, as more decide nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.near_duplicates import similar_classes
from quillon.session import stored

GRAM, WINDOW, LEAST_REPOS, LEAST_ALIKE, LEAST_PRINTS, LEAST_TOKENS = 6, 8, 2, 0.75, 12, 20

CODE = {"py", "js", "mjs", "cjs", "jsx", "ts", "tsx", "java", "go", "css", "scss", "less", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "rs", "kt", "swift", "scala", "sh", "bash", "lua", "pl", "sql", "m", "vue"}
COMMANDS = {"sh", "bash", "sql"}  # lists of commands that people write line by line
LOCK_NAMES = {"package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "go.sum", "go.work.sum", "poetry.lock", "cargo.lock", "composer.lock", "gemfile.lock", "pipfile.lock", "uv.lock", "pdm.lock", "bun.lockb", "mix.lock", "pubspec.lock", "podfile.lock", "packages.lock.json", "flake.lock", "gradle.lockfile"}
VENDOR_DIRS = re.compile(r"(?i)(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|3rd[_-]?party|node_modules|bower_components|extern(?:al)?s?|deps|contrib/imported|site-packages|godeps/_workspace|pods)/")
GENERATED_DIRS = re.compile(r"(?i)(?:^|/)(?:gen|autogen|auto-?generated|__generated__|generated|gensrc)/")
VERSIONED = re.compile(r"(?i)(?:^|/)[\w.]+(?:-[\w.]+)*?[-.]v?\d+\.\d+\.\d+(?:\.min)?\.(?:py|js|mjs|ts|java|go|css|c|h|rb|php)$")
VENDOR_NOTICE = re.compile(
    r"(?i)\bvendored (?:from|copy)\b|\bplease (?:send|submit) (?:patches|changes) upstream|^\W*upstream: |\(c\) \d{4}.*\bcontributors\b.*\breleased under\b|\breleased under the [\w\-. ]+ licen[cs]e|\bcopied (?:verbatim )?from https?://|^\W*imported from [\w\-]+ v?\d+\.\d+|@license\b.*\bv?\d+\.\d+"
)
GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b|\bcode generated\b|\b(?:generated|created|produced|written) automatically\b|\bgenerated (?:by|from)\b|\bautomatically (?:generated|created|produced)\b|(?:\bwas|\bis|\bbeen) generated\b|\bdo not (?:edit|modify|change)\b"
    r"|\bhand[- ]edits (?:are|will be) (?:overwritten|lost)|\b(?:changes|edits|modifications)\b.{0,30}\bwill be (?:lost|overwritten)|\bbuilt by\b.{0,60}\b(?:run it again|instead of)\b|\bregenerate (?:with|using|by)\b"
    r"|\bautomatisch\b.{0,60}\b(?:erzeugt|generiert|erstellt)|\bnicht (?:ändern|bearbeiten)\b|\bgénéré automatiquement|\bne pas modifier\b|\bgenerado automáticamente|\bno (?:editar|modificar)\b|\bgerado automaticamente|\bnão (?:editar|editar|modifique)\b|\bautomatisch gegenereerd|\bniet (?:wijzigen|bewerken)\b"
)
#: Sentences of hand-written files about such files.
ABOUT = re.compile(r"(?i)(['\"`‘“«])[^'\"`’”»]*(?:do not edit|generated)[^'\"`’”»]*['\"`’”»]|\bedited by hand\b|^\W*(?:writes?|emits?|checks?|creates?|produces?|reads?|parses?|tests?|removes?|adds?|prints?|returns?|inserts?|detects?|skips?|lists?|finds?)\b|\bnot (?:auto-?)?generated\b")
TAIL_NOTICE = re.compile(r"(?i)\bend of [\w\-]+ output\b|\bend of generated\b|\bsource checksum [0-9a-f]{16,}")
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;|%|'|\"\"\"|REM\b|@)")
BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
QUOTES = {'"""', "'''"}
LITERAL = re.compile(r"([\"'`])[A-Za-z0-9+/=_\-.:;,%]{80,}\1")  # an embedded image or the like, no code between two quotes
ATOM = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\b0[xX][0-9a-fA-F]+\b|[-+]?\b\d[\d_.]*(?:[eE][-+]?\d+)?\b")
NAME = re.compile(r"[A-Za-z_$][\w$]*")


def head_comments(lines: list[str], more: int) -> list[str]:
    """The comment lines before the first line of code, however many, and those among the ``more`` lines from there on.

    All lines within ``/* */`` and ``<!-- -->`` are comments.  Of a docstring only its first line is, as it may describe other files.
    """
    out, close, at = [], "", 0
    for at, line in enumerate(lines):
        if close:
            if close not in QUOTES or COMMENT.match(line):
                out.append(line)
            if close in line:
                close = ""
        elif not line.strip():
            continue
        elif COMMENT.match(line):
            out.append(line)
            start = line.strip()
            close = next((end for begin, end in BLOCKS if start.startswith(begin) and end not in start[len(begin) :]), "")
        else:
            break
    else:
        if not close:
            return out
        # a block without an end, as after a cut of the file, hides no more than its lines
        at = len(lines)
    return out + [x for x in lines[at : at + more] if COMMENT.match(x)]


def tail_comments(lines: list[str], more: int) -> list[str]:
    """The comment lines after the last line of code, however many, and those among the last ``more`` lines."""
    at, close = len(lines), ""
    while at:
        line = lines[at - 1].strip()
        if close:
            close = "" if close in line else close
        elif line and not COMMENT.match(line):
            if not line.endswith("*/") and not line.endswith("-->"):
                break
            close = "/*" if line.endswith("*/") else "<!--"
            if close in line:  # code with a remark behind it
                break
        elif line.endswith(("*/", "-->")):
            begin = "/*" if line.endswith("*/") else "<!--"
            close = "" if begin in line else begin
        at -= 1
    own = [] if close else lines[at:]
    return own + [x for x in lines[-more:] if COMMENT.match(x)]


def file_reason(path: str | None, text: str | None) -> str | None:
    """``lock``, ``generated``, ``minified`` or ``data`` by the file alone, else null."""
    path, text = path or "", text or ""
    name = path.rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if name in LOCK_NAMES or name.endswith("-lock.json") or (ext == "lock" and "." in name):
        return "lock"
    if re.search(r"(?:_pb2(?:_grpc)?\.pyi?|_pb(?:_service)?\.(?:js|ts|d\.ts|rb|php)|\.pb\.(?:go|cc|h|c)|\.g\.dart|\.designer\.cs|_generated\.\w+|\.generated\.\w+|\.gen\.\w+)$", name):
        return "generated"
    if not text.strip():
        return None
    lines = text.split("\n")
    for line in head_comments(lines, 15):
        # in prose only a comment counts; code may also say it right at its first line
        if len(line) < 600 and not (ext in {"md", "rst", "txt"} and not line.lstrip().startswith("<!--")) and GENERATED.search(line) and not ABOUT.search(line):
            return "generated"
    if any(TAIL_NOTICE.search(x) for x in tail_comments(lines, 4)):
        return "generated"
    if ext in {"map"} and text.lstrip().startswith("{") and '"mappings"' in text:
        return "generated"
    if ext in CODE:
        if re.search(r"\.min\.(?:js|mjs|css)$", name) and (text.count("\n") < 30 or len(text) / (text.count("\n") + 1) > 120):
            return "minified"
        if max(map(len, lines)) > 150:
            plain = [x for x in LITERAL.sub('""', text).split("\n") if x.strip()]
            if sum(map(len, plain)) > 80 * len(plain) and _dense("".join(plain)):
                return "minified"
        if len(text) > 400:
            names = NAME.findall(ATOM.sub(" ", text))
            atoms = ATOM.findall(text)
            if len(atoms) > 30 and sum(map(len, names)) < 0.12 * len(text) and len(atoms) > 4 * len(names):
                return "data"
            blob = re.findall(r"^\s*[\"'`]?[A-Za-z0-9+/=\\]{40,}[\"'`]?[,+)\]]?;?\s*$", text, re.M)
            if sum(map(len, blob)) > 0.7 * len(text):
                return "data"
        if ext not in COMMANDS and (repetitive(text) or (GENERATED_DIRS.search(path) and repetitive(text, least_lines=5))):
            return "generated"
    return None


def repetitive(text: str, least_lines: int = 12, shapes: int = 3, share: float = 0.9) -> bool:
    """Whether nearly all lines have one of a few shapes once names and numbers are blotted out, as tools write them."""
    lines = [x for x in text.split("\n") if x.strip() and not COMMENT.match(x)]
    if len(lines) < least_lines:
        return False
    counts: dict[str, int] = {}
    for x in lines:
        shape = NAME.sub("a", ATOM.sub("0", x.strip()))
        counts[shape] = counts.get(shape, 0) + 1
    return sum(sorted(counts.values())[-shapes:]) >= share * len(lines) and any(NAME.search(x) for x in lines[:3])


def _dense(line: str) -> bool:
    """Code without the blanks people write."""
    marks = sum(line.count(c) for c in "{};=()[],:")
    return marks > 0.1 * len(line) and line.count(" ") < 0.1 * len(line)


def says_vendored(path: str | None, text: str | None) -> bool:
    """Whether a file's place, name or notice says that it is a copy of third-party code."""
    path, text = path or "", text or ""
    if VENDOR_DIRS.search(path) or VERSIONED.search(path):
        return True
    return any(len(x) < 400 and VENDOR_NOTICE.search(x) and not ABOUT.search(x) for x in head_comments(text.split("\n"), 10))


def _is_word() -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ("az", "AZ", "09"):
        out[ord(r[0]) : ord(r[1]) + 1] = True
    out[ord("_")] = True
    out[128:] = True
    return out


WORD_BYTE = _is_word()
WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")


def fingerprints(texts: list[bytes], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of many texts at once: ``(index of the text, fingerprint)``, each pair once.

    Tokens are words; case, white space and punctuation don't count.  A text of fewer than ``gram`` tokens has none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = WORD_BYTE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begin) < gram:
        return none
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_end, begin, side="right")
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    # the hash of a token: its bytes weighted by powers of an odd number counted from the token's start
    size = end - begin
    flat = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(512, 0x100000001B3, np.uint64))
    token = np.add.reduceat(low[flat] * power[place & 511], np.cumsum(size) - size)
    token = (token ^ (token >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    count = len(token) - gram + 1
    run = np.zeros(count, np.uint64)
    for k in range(gram):
        run = run * np.uint64(0x9E3779B97F4A7C15) + token[k : k + count]
    run = (run ^ (run >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    run ^= run >> np.uint64(30)
    inside = doc[:count] == doc[gram - 1 : gram - 1 + count]
    run, owner = run[inside], doc[:count][inside]
    if not len(run):
        return none
    best = run.copy()
    for k in range(1, window):  # a window is cut short at the end of its text
        ahead = np.full(len(run), np.iinfo(np.uint64).max, np.uint64)
        same = owner[:-k] == owner[k:] if k < len(owner) else np.zeros(0, bool)
        ahead[: len(same)][same] = run[k:][same]
        np.minimum(best, ahead, out=best)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    position = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
    length = np.bincount(owner, minlength=len(texts))[owner]
    keep = (position <= length - window) | (position == 0)
    keep &= np.concatenate([[True], (best[1:] != best[:-1]) | first[1:]])
    pairs = np.unique(np.stack([owner[keep].astype(np.uint64), best[keep]], 1), axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def token_stream(text: bytes) -> bytes | None:
    """A hash of all tokens in their order; null under ``LEAST_TOKENS``."""
    tokens = WORD.findall(text.lower())
    return hashlib.md5(b" ".join(tokens)).digest() if len(tokens) >= LEAST_TOKENS else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, texts = b.column("path").to_pylist(), b.column("text").to_pylist()
        reasons = [file_reason(p, t) for p, t in zip(paths, texts)]
        marked = [says_vendored(p, t) for p, t in zip(paths, texts)]
        code = [i for i, p in enumerate(paths) if p and p.rsplit(".", 1)[-1].lower() in CODE and reasons[i] != "data" and texts[i]]
        keys: list = [None] * len(paths)
        prints: list = [None] * len(paths)
        for lo in range(0, len(code), 400):
            at = code[lo : lo + 400]
            raw = [texts[i].encode("utf-8", "replace") for i in at]
            doc, mark = fingerprints(raw)
            cut = np.searchsorted(doc, np.arange(len(at) + 1))
            signed = mark.view(np.int64)
            for k, i in enumerate(at):
                own = signed[cut[k] : cut[k + 1]]
                if len(own) >= LEAST_PRINTS:
                    keys[i], prints[i] = hashlib.md5(own.tobytes()).digest(), own
                else:
                    keys[i] = token_stream(raw[k])
        yield pa.record_batch(
            [b.column("repo_id"), b.column("path"), pa.array(reasons, pa.string()), pa.array(marked, pa.bool_()), pa.array(keys, pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
            ["repo_id", "path", "reason", "marked", "key", "prints"],
        )


def source_kinds(df: DataFrame, least_repos: int = LEAST_REPOS, least_alike: float = LEAST_ALIKE, marks: bool = True) -> DataFrame:
    """``(repo_id, path, reason, shared_prints)``: one row per file; ``reason`` is generated, lock, minified, data, vendored, third_party or null.

    Fingerprints alone decide ``vendored``.  ``third_party`` is a file that recurs nowhere but says by its notice or place that it is
    a copy; ``marks=False`` leaves those out.  ``shared_prints`` is the likeness to the common origin a file is most like, 1 where it
    is one itself, 0 without one, and null for what isn't compared: no code, data, no text, or too few tokens.  A file listed twice
    counts once (a reason found in one listing holds).  Null paths and texts are judged by what is there.
    """
    seen = df.select("repo_id", "path", "text").mapInArrow(_scan, "repo_id string, path string, reason string, marked boolean, key binary, prints array<long>")
    files = stored(seen.withColumns({"file": F.unhex(F.md5(F.to_json(F.struct("repo_id", "path")))), "repo": F.unhex(F.md5(F.coalesce("repo_id", F.lit(""))))}))
    compared = files.where("key is not null")
    classes = stored(compared.where("prints is not null").groupBy("key").agg(F.first("prints").alias("words")))
    near = similar_classes(classes, least_alike).select("key_a", "key_b", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("alike"))
    near = stored(near)
    # of each class no more repositories than decide
    first = Window.partitionBy("key").orderBy("repo")
    places = stored(compared.select("key", "repo").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= least_repos).drop("nth"))
    both = near.select(F.col("key_a").alias("origin"), F.col("key_b").alias("key"), "alike").unionByName(near.select(F.col("key_b").alias("origin"), F.col("key_a").alias("key"), "alike"))
    around = both.join(places, "key").select("origin", "repo").unionByName(places.select(F.col("key").alias("origin"), "repo"))
    origins = stored(around.distinct().groupBy("origin").agg(F.count("*").alias("repos")).where(F.col("repos") >= least_repos).select("origin"))
    like = both.join(origins, "origin").select("key", "alike").unionByName(origins.select(F.col("origin").alias("key"), F.lit(1.0).alias("alike"))).groupBy("key").agg(F.max("alike").alias("alike"))
    shared = compared.select("file", "key").join(like, "key").groupBy("file").agg(F.max("alike").alias("alike"))
    one = files.groupBy("file").agg(F.first("repo_id").alias("repo_id"), F.first("path").alias("path"), F.max("reason").alias("reason"), F.max("marked").alias("marked"), F.max(F.col("key").isNotNull()).alias("compared"))
    out = one.join(shared, "file", "left")
    said = F.when(F.col("marked"), "third_party") if marks else F.lit(None).cast("string")
    reason = F.coalesce("reason", F.when(F.col("alike").isNotNull(), "vendored"), said)
    return out.select("repo_id", "path", reason.alias("reason"), F.round(F.when(F.col("compared"), F.coalesce("alike", F.lit(0.0))), 4).alias("shared_prints"))
