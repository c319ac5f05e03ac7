"""Credentials in source code and configuration: finding them and masking them in place.

Configuration files, told by their path, are parsed into key paths with the offsets of their values (``config_values``).  A value
counts when a part of its key path names something secret, no part below that names something else, and the value has the shape
of a secret.  In all texts lines are searched for assignments too, whose value counts by the last part of its key; keys with a
public format, user information in URLs, authorization headers, command options, remarks and private key blocks count by their
own forms.  Masking is spliced into the bytes of the text: each byte of a value but line ends becomes ``MASK``, a letter that is
a plain value in every format, so line breaks, quotes, byte offsets and everything around stay as they were.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from quillon.llm.config_values import config_values


#: What bytes of a value become: a letter, since ``*`` or ``#`` would begin something else in YAML, INI or a shell.
MASK = b"x"


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    key_path: str


# Formats of keys that providers publish (fixed values).
PUBLIC_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|xapp-[A-Za-z0-9\-]{10,}"
    r"|AIza[A-Za-z0-9_\-]{35}"
    r"|[sr]k_live_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{16,}"
    r"|sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{32,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"
    r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{32,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|SK[0-9a-f]{32}|ya29\.[A-Za-z0-9_\-]{20,}"
    r")(?![A-Za-z0-9_])"
)
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s/\"'`<>]+)@(?=[A-Za-z0-9\[])")
HEADER = re.compile(r"(?i)\b(bearer|basic|token|apikey)[ \t]+([A-Za-z0-9_\-.~+/]{16,}={0,2})")
OPTION = re.compile(r"(?i)(?:--?(?:password|passwd|passphrase|pass|pwd|token|secret|api-?key|auth-token|access-key|client-secret)(?:[= \t]+)|\b(?:password|passwd|passphrase|pwd)[ \t]+(?:is[ \t]+)?)([\"'`]?)([^\s\"'`,;]{6,})\1")
USER_OPTION = re.compile(r"(?:\s-u|--user)[ =]+([\"']?)([^\s:\"'/]+):([^\s\"'@]{6,})\1(?=[\s\"']|$)")
SECRET_KEY = r"(?i:[\w.\-]*(?:passw(?:or)?d|passwd|pwd|passphrase|pass|passcode|secret|token|credentials?|keys?|pat|auth)(?:[_.\-]?(?:id|value|hex))?)"
CALLED = re.compile(r"(?i)\.(?:login|log_?in|auth|authenticate|connect|check|verify|sign_?in|basic_?auth|authorize)\(\s*([\"'`])[^\"'`\n]*\1\s*,\s*([\"'`])([^\"'`\s]{6,})\2")
ELEMENT = re.compile(r"<(" + r"(?i:[\w.\-]*(?:password|passwd|pwd|passphrase|secret|token|key))" + r")>([^<>\s]{6,})</\1>")
JOINED = re.compile(r"([\"'`])[ \t]*\+[ \t]*\1")
PAIRED = re.compile(r"([\"'`])(" + SECRET_KEY + r")\1[ \t]*,[ \t]*([\"'`])([^\"'`\s]{6,})\3")
ATTACHED = re.compile(r"\b(?:mysql\w*|mariadb|sshpass|mongo\w*|redis-cli|psql|ftp)\b[^\n]*?[ \t]-[pa]([\"']?)([^\s\"']{6,})\1(?=\s|$)")
NAME_VALUE = re.compile(r"\bname[\"']?:[ \t]*[\"']?(" + SECRET_KEY + r")[\"']?,?\s*[\"']?value[\"']?:[ \t]*([\"']?)([^\s\"',]{6,})\2")
NAMED_AFTER = re.compile(r"(\S{8,})[ \t]+\(([A-Za-z_][\w.\-]*)\)")
ASSIGNED = re.compile(
    r"(?<![\w.\-])(" + SECRET_KEY + r")[\"'`]?\]?[ \t]*(?:[ \t]*:[ \t]*[A-Za-z_][\w<>\[\]. |]*?(?=[ \t]*=[^=]))?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*"
    r"(?:(?P<q>\"\"\"|'''|[\"'`])(?P<quoted>[^\n]*?)(?P=q)|(?P<bare>[^\s\"'`,;(){}\[\]<>|]{6,}))"
)

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PASSWORD_WORDS = {"password", "passwd", "passwort", "pwd", "passphrase", "pass", "passcode"}
_SECRET_WORDS = {"secret", "secrets", "token", "tokens", "apikey", "credential", "credentials", "pat", "auth"}
_KEY_QUALIFIERS = {"api", "access", "secret", "private", "auth", "llm", "signing", "encryption", "service", "account", "license", "master", "x", "client", "app", "admin", "storage", "subscription"}
_NOT_SECRET = {"public", "name", "hash", "digest", "sha", "checksum", "count", "limit", "length", "type", "header", "field", "path", "file", "url", "request", "commit", "etag", "version", "ttl", "expiry"}
_BESIDE_SECRET = _NOT_SECRET | {"user", "username", "login", "email", "host", "hostname", "port", "region", "provider", "kind", "id", "uid", "enabled", "scope", "scopes", "issuer", "audience", "expires", "created", "updated", "description", "comment", "label", "title", "endpoint", "realm", "algorithm", "prefix", "domain", "mode", "format", "image", "tag", "ref", "revision"}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.\-_#0?]{4,}|<.*>|\[.*\]|%.*%|your[-_ ]?.*|my[-_ ]?(?:password|secret|token|key)|replace[-_ ]?.*|change[-_ ]?.*|put[-_ ]?.*|insert[-_ ]?.*|example.*|dummy.*|fake.*|sample.*|placeholder.*|redacted.*"
    r"|todo|tbd|none|null|nil|true|false|undefined|secret|password|passwd|token|test(?:ing)?|foo|bar|abc123|\S*(?:xxxx|\*\*\*\*)\S*)$"
)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|%\(|^\$|^\{|^%[sdv]|^@|^env[.:(]|^os\.|^process\.|getenv|environ|^vault[/:]|^arn:|^ref\+|^ssm:|^file:|^kms:|^ENC\[|^(?:sha\d+|md5)[:\-]")
_HEX = re.compile(r"^[0-9a-fA-F]{24,}$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def is_placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.match(value) or _REFERENCE.search(value))


def password_shape(value: str) -> bool:
    """A password: no plain word, path, identifier or number."""
    if len(value) < 6 or any(c.isspace() for c in value) or is_placeholder(value):
        return False
    low, up = any(c.islower() for c in value), any(c.isupper() for c in value)
    digit, mark = any(c.isdigit() for c in value), any(not c.isalnum() and c not in "_-./" for c in value)
    if not (low or up) or re.fullmatch(r"[\w.]+\([^)]*\)?;?|[A-Za-z_][\w.]*\[\S*|v?\d+(?:\.\d+)+\S*", value):
        return False
    if re.fullmatch(r"[a-z]+(?:[/.][a-z]+)+|[A-Z][A-Z_]+|[a-z_]+|[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]+)*", value):
        return False
    return digit or (mark and (low and up)) or (low and up and any(c in "_-." for c in value))


def key_shape(value: str) -> bool:
    """A key or token: long, and hexadecimal, a UUID, or a mixture of letters and digits."""
    if len(value) < 16 or any(c.isspace() for c in value) or is_placeholder(value):
        return False
    if _UUID.match(value) or _HEX.match(value):
        return True
    body = value.rstrip("=")
    if value[0] in "&*!@#":
        return False
    if not re.fullmatch(r"[A-Za-z0-9+/_\-.~]+", body):
        return password_shape(value)
    digits = sum(c.isdigit() for c in body)
    mixed = any(c.islower() for c in body) and any(c.isupper() for c in body)
    return len(body) >= 16 and ((mixed and digits >= 1) or (mixed and len(body) >= 24 and not re.fullmatch(r"[A-Za-z]+(?:[_./-][A-Za-z]+)*", body)) or (digits >= 4 and not re.search(r"[/.]", body) and bool(re.search(r"[A-Za-z]", body)) and not re.search(r"[a-z]{6,}", body)))


def key_class(name: str) -> str | None:
    """What the last part of a key path promises: ``password``, ``key`` or nothing secret."""
    last = re.split(r"[.\[\]]", name.strip("\"'`"))[-1] or name
    words = [w.lower() for w in _WORDS.findall(last)]
    if not words:
        return None
    while len(words) > 1 and words[-1] in {"value", "hex", "id"}:
        words.pop()
    tail = words[-1]
    if "public" in words or tail in _NOT_SECRET:
        return None
    if tail in _PASSWORD_WORDS or last.lower().endswith(("password", "passwd", "passphrase")):
        return "password"
    if tail in _SECRET_WORDS or last.lower().endswith(("apikey", "secretkey", "authtoken")):
        return "key"
    if tail in {"key", "keys"} and set(words[:-1]) & _KEY_QUALIFIERS:
        return "key"
    return None


def path_class(parts: tuple[str, ...]) -> tuple[str, bool] | None:
    """What the nearest part of a key path that tells promises, and whether it is the last one; null if it isn't a secret."""
    for k, part in enumerate(reversed(parts)):
        kind = key_class(part) or (key_class(part[:-1]) if part[-1:] in {"s", "S"} else None)
        words = [w.lower() for w in _WORDS.findall(part)]
        if kind and not (k and words[-1] in {"auth", "pat"}):
            return kind, k == 0
        if words and ("public" in words or words[-1] in _BESIDE_SECRET):
            return None
    return None


def secret_below(kind: str, value: str) -> bool:
    """The shape of a secret whose own key doesn't say that it is one: a key, or a password with a mark unless one is promised."""
    return key_shape(value) or (password_shape(value) and (kind == "password" or any(not c.isalnum() and c not in "_-./@:" for c in value)))


_SECTION = re.compile(r"^[ \t]*\[+([^\]\n]+)\]+[ \t]*$", re.M)
_PARENT = re.compile(r"\s*-?\s*[\"']?([\w.\-]+)[\"']?\s*:\s*[{\[]?\s*$")


def key_path(text: str, at: int, key: str, sections: list[tuple[int, str]]) -> str:
    """The path of a key at an offset: the less indented keys above it, or its section, then the key.

    ``sections`` are the offsets and names of all section lines of the text.
    """
    start = text.rfind("\n", 0, at) + 1
    if text[start:at].strip("\"' \t-"):
        return key
    parents: list[str] = []
    depth = len(text[start:at]) - len(text[start:at].lstrip(" \t"))
    last = bisect_left(sections, (start, "")) - 1
    floor = sections[last][0] if last >= 0 else -1
    while depth and start > floor + 1 and start > 0:
        stop = start - 1
        start = text.rfind("\n", 0, stop) + 1
        line = text[start:stop]
        width = len(line) - len(line.lstrip(" \t"))
        if width < depth and (parent := _PARENT.match(line)):
            parents.append(parent[1])
            depth = width
    if last >= 0:
        parents.append(sections[last][1])
    return ".".join([*reversed(parents), key])


# The lines of a private key whose END mark is missing: base64 with digits among it, escaped or quoted line ends between.
_KEY_LINE = re.compile(r"(?:\\[nr]|[\s\"'`+,#*|>])*(?:(?:Proc-Type|DEK-Info):[^\n]*|(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{16,}={0,2}(?![\w(.]))")
_KEY_REST = re.compile(r"(?:\\[nr]|[\s\"'`+])+[A-Za-z0-9+/]{1,15}={1,2}(?![\w=])")
_KEY_BODY = re.compile(r"(?<![A-Za-z0-9+/])(?!x{16})[A-Za-z0-9+/]{16,}")


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Where each private key begins, at its BEGIN mark, and where its body ends: at its END mark or after its last line."""
    begins = list(PRIVATE_KEY.finditer(text))
    for k, m in enumerate(begins):
        limit = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        if stop := PRIVATE_END.search(text, m.end(), limit):
            end = stop.start()
        else:
            end = m.end()
            while line := _KEY_LINE.match(text, end, limit):
                end = line.end()
            if end > m.end() and (rest := _KEY_REST.match(text, end, limit)):
                end = rest.end()
        if _KEY_BODY.search(re.sub(r"\\[nr]", "\n", text[m.end() : end])) or not text[m.end() :].strip(" \t\r\n\"'`"):
            yield m.start(), end


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ",;":
        end -= 1
    return start, end


def _in_joined_literals(text: str) -> list[Finding]:
    """Findings of lines whose string literals are put together with ``+``, as if each were written in one piece."""
    out, at = [], 0
    for line in text.split("\n"):
        gaps = [(m.start(), m.end()) for m in JOINED.finditer(line)]
        if gaps:
            keep = [i for i in range(len(line)) if not any(a <= i < b for a, b in gaps)]
            for f in find("".join(line[i] for i in keep), joined=False):
                out.append(Finding(at + keep[f.start], at + keep[f.end - 1] + 1, f.kind, f.key_path))
        at += len(line) + 1
    return out


def find(text: str | None, joined: bool = True, path: str | None = None) -> list[Finding]:
    """All credentials of a text, in order, without overlaps; offsets are code points of ``text``; ``path`` tells its format."""
    if not text:
        return []
    found: list[Finding] = []

    def add(start: int, end: int, kind: str, key: str) -> None:
        found.append(Finding(start, end, kind, key))

    for parts, start, end in config_values(path, text):
        start, end = _trim(text, start, end)
        if end - start >= 6 and (told := path_class(parts)):
            kind, own = told
            value = text[start:end]
            if (password_shape if kind == "password" else key_shape)(value) if own else secret_below(kind, value):
                add(start, end, kind, ".".join(parts))
    if "PRIVATE KEY" in text:
        for start, end in private_keys(text):
            add(start, end, "private_key", "private_key")
    for m in PUBLIC_FORMATS.finditer(text):
        if not is_placeholder(m[0]) and not re.search(r"(?i)example|x{6}", m[0]):
            add(m.start(), m.end(), "provider_key", "")
    if "://" in text:
        for m in URL_USER.finditer(text):
            password = m[2]
            if not is_placeholder(password) and not re.search(r"[{}]", password) and len(password) >= 4 and not re.fullmatch(r"(?i)\d{1,5}|pass(?:word)?|pwd|secret", password):
                add(m.start(2), m.end(2), "url_password", m[1])
    low = text.lower()
    if "bearer" in low or "basic" in low or "authorization" in low:
        for m in HEADER.finditer(text):
            if not is_placeholder(m[2]) and key_shape(m[2]):
                add(m.start(2), m.end(2), "authorization", m[1].lower())
    sections: list[tuple[int, str]] | None = None
    for m in ASSIGNED.finditer(text):
        kind = key_class(m[1])
        group = "quoted" if m["quoted"] is not None else "bare"
        value = m[group]
        if not kind or not value:
            continue
        start, end = _trim(text, m.start(group), m.end(group)) if group == "bare" else (m.start(group), m.end(group))
        if (password_shape if kind == "password" else key_shape)(text[start:end]):
            if sections is None:
                sections = [(x.start(), x[1]) for x in _SECTION.finditer(text)]
            add(start, end, kind, key_path(text, m.start(1), m[1], sections))
    if "pass" in low or "pwd" in low or "token" in low or "key" in low or "secret" in low:
        for m in OPTION.finditer(text):
            if password_shape(m[2]) and not m[2].startswith(("=", ":")):
                add(m.start(2), m.end(2), "option", "password")
        for m in NAMED_AFTER.finditer(text):
            kind = key_class(m[2])
            if kind and (password_shape if kind == "password" else key_shape)(m[1]):
                add(m.start(1), m.end(1), kind, m[2])
        for pattern, key, value in ((PAIRED, 2, 4), (NAME_VALUE, 1, 3)):
            for m in pattern.finditer(text):
                kind = key_class(m[key])
                if kind and (password_shape if kind == "password" else key_shape)(m[value]):
                    add(m.start(value), m.end(value), kind, m[key])
    if " -p" in text or " -a" in text:
        for m in ATTACHED.finditer(text):
            if password_shape(m[2]):
                add(m.start(2), m.end(2), "option", "password")
    if "-u" in text or "--user" in text:
        for m in USER_OPTION.finditer(text):
            if password_shape(m[3]):
                add(m.start(3), m.end(3), "option", "user")
    for m in CALLED.finditer(text):
        if password_shape(m[3]) or key_shape(m[3]):
            add(m.start(3), m.end(3), "call", "")
    if "</" in text:
        for m in ELEMENT.finditer(text):
            kind = key_class(m[1])
            if kind and (password_shape if kind == "password" else key_shape)(m[2]):
                add(m.start(2), m.end(2), kind, m[1])
    if joined and JOINED.search(text):
        found += _in_joined_literals(text)
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def byte_spans(text: str, findings: list[Finding]) -> Iterator[tuple[int, int, int]]:
    """``(line, start, end)`` of each finding: the line from 1 and the offsets in UTF-8 bytes."""
    line, at, byte = 1, 0, 0
    for f in findings:
        line += text.count("\n", at, f.start)
        byte += len(text[at : f.start].encode("utf-8", "surrogatepass"))
        at = f.start
        yield line, byte, byte + len(text[f.start : f.end].encode("utf-8", "surrogatepass"))


_MASKED = re.compile(rb"[^\r\n]")
_MASKED_KEY = re.compile(rb"(\\[nrt]|-----BEGIN [A-Z0-9 ]+-----)|[A-Za-z0-9+/=]{2,}")


def redact(text: str | None, findings: list[Finding] | None = None, path: str | None = None) -> str | None:
    """The text with the bytes of each finding overwritten by ``MASK``; line ends stay, and of a private key its marks and quotes."""
    if not text:
        return text
    hits = find(text, path=path) if findings is None else findings
    raw = text.encode("utf-8", "surrogatepass")
    parts, last = [], 0
    for f, (_, start, end) in zip(hits, byte_spans(text, hits)):
        value = raw[start:end]
        masked = _MASKED_KEY.sub(lambda m: m[1] or MASK * len(m[0]), value) if f.kind == "private_key" else _MASKED.sub(MASK, value)
        parts += [raw[last:start], masked]
        last = end
    return b"".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")


def find_credentials(df: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """``(id, line_no, start_byte, end_byte, kind, key_path)``: one row per finding, offsets in the UTF-8 bytes of the text.

    Null and empty texts give no rows, a null id stays null, repeated rows give repeated findings once.  Without a column of
    paths, or with a null path, no format is known.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, path in zip(b["id"], b["text"], b["path"]):
                hits = find(text, path=path)
                rows += [(i, line, start, end, f.kind, f.key_path) for f, (line, start, end) in zip(hits, byte_spans(text or "", hits))]
            yield pd.DataFrame(rows, columns=["id", "line_no", "start_byte", "end_byte", "kind", "key_path"])

    kind = df.schema[id_col].dataType.simpleString()
    path = f"`{path_col}`" if path_col in df.columns else "cast(null as string)"
    return df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text", f"{path} as path").mapInPandas(run, f"id {kind}, line_no int, start_byte long, end_byte long, kind string, key_path string").distinct()


def redact_credentials(df: DataFrame, text_col: str = "text", path_col: str = "path") -> DataFrame:
    """The same rows with ``text_col`` masked and a count ``credentials_masked`` added; null texts stay null with count 0."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("n", IntegerType())]))
    def mask(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = []
        for t, path in zip(texts, paths):
            hits = find(t, path=path)
            rows.append((redact(t, hits), len(hits)))
        return pd.DataFrame(rows, columns=["text", "n"])

    masked = df.withColumn("__masked", mask(F.col(text_col), F.col(path_col) if path_col in df.columns else F.lit(None).cast("string")))
    return masked.withColumns({text_col: F.col("__masked.text"), "credentials_masked": F.col("__masked.n")}).drop("__masked")
