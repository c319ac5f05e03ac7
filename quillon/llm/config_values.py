"""Values of configuration files with their full key paths and offsets: YAML, JSON, TOML, INI, properties, env and XML files.

The texts are pieces of files, so nothing is refused: what isn't understood is passed over, brackets that were opened before the
piece are ignored, and those left open end with it.  Offsets are code points and enclose the value without its quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Parts of the key path, start and end of the value.
Value = tuple[tuple[str, ...], int, int]

FORMATS = {
    **dict.fromkeys(("yaml", "yml"), "yaml"),
    **dict.fromkeys(("json", "jsonc", "json5", "ipynb", "webmanifest"), "json"),
    **dict.fromkeys(("toml", "ini", "cfg", "conf", "cnf", "config", "properties", "props", "env", "envrc", "npmrc", "pypirc"), "lines"),
    **dict.fromkeys(("xml", "plist", "csproj", "resx"), "xml"),
}
_KEY = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|[^\s\"'#\[\]{},&*!|>%@`:-][^\n:#{}\[\],]*?|-[^\s:][^\n:#{}\[\],]*?)"
_ENTRY = re.compile(r"([ \t]*)((?:-[ \t]+)*)(?:\?[ \t]+)?(" + _KEY + r")[ \t]*:(?=[ \t]|\r?$)[ \t]*")
_ITEM = re.compile(r"([ \t]*)((?:-[ \t]+)*-)(?:[ \t]+|(?=\r?$))")
_TAGS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)*")
_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*(?:#.*)?\r?$")
_SECTION = re.compile(r"[ \t]*\[+[ \t]*([^\]\n]+?)[ \t]*\]+[ \t]*(?:[#;].*)?\r?$")
_SETTING = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+)?(\"[^\"\n]*\"|'[^'\n]*'|[^\s=:#;\[\"'{}][^=:\n\"'{}]*?)[ \t]*[=:](?![=:])[ \t]*")
_PARTS = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^.\s\"']+)")
_TOKEN = re.compile(r"\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/|(?<![^\s,\[{])#[^\n]*|[{}\[\],]|[:=](?=[\s\"'\[{])|[^\s,\[\]{}\"':=#](?:[^\s,\[\]{}\"':=]|[:=](?![\s\"'\[{]))*|[:=]", re.S)


def config_format(path: str | None) -> str | None:
    """``yaml``, ``json`` or ``lines`` by the name of a file, null for others."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    if name == ".env" or name.startswith(".env."):
        return "lines"
    return FORMATS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def config_values(path: str | None, text: str) -> Iterator[Value]:
    kind = config_format(path)
    if kind == "yaml":
        yield from _yaml(text)
    elif kind == "json":
        yield from _flow(text, 0, (), whole=True)[0]
    elif kind == "xml" or (kind == "lines" and text.lstrip().startswith("<") and path.lower().endswith(".config")):
        yield from _xml(text)
    elif kind == "lines":
        yield from _lines(text)


def _flow(text: str, at: int, parents: tuple[str, ...], whole: bool = False) -> tuple[list[Value], int]:
    """Values of nested braces and brackets from ``at`` on, and where they end; ``whole``: up to the end of the text."""
    out: list[Value] = []
    # of each open bracket the key before it; the outermost stands for what was opened before the text
    frames: list[tuple[str, ...]] = [parents]
    key: list[str] = []
    last: tuple[int, int] | None = None
    named = False  # a key was read and its value wasn't yet

    def leave() -> None:
        nonlocal last, named
        if last:
            out.append(((*frames[-1], *key), *last))
        last, named = None, False
        key.clear()

    while m := _TOKEN.search(text, at):
        t, at = m[0], m.end()
        if t in "{[":
            last = None
            frames.append((*frames[-1], *key))
            key.clear()
            named = False
        elif t in "}]":
            leave()
            if len(frames) > 1:
                frames.pop()
            if len(frames) == 1 and not whole:
                return out, at
        elif t == ",":
            leave()
        elif t in ":=" and len(t) == 1:
            if last and not named:
                key[:] = [text[last[0] : last[1]]]
                last, named = None, True
        elif t.startswith(("//", "/*", "#")):
            continue
        elif t[0] in "\"'" and len(t) > 1 and t[-1] == t[0]:
            if last and "\n" in text[last[1] : m.start()]:
                leave()  # a comma is missing
            last = (m.start() + 1, m.end() - 1)
        else:
            if last and "\n" in text[last[1] : m.start()]:
                leave()
            last = (last[0], m.end()) if last else (m.start(), m.end())
    leave()
    return out, len(text)


def _scalar(text: str, at: int, stop: int, marks: str) -> tuple[int, int, int]:
    """Start and end of the quoted or plain value at ``at``, and where reading goes on; plain ones end with the line or a remark."""
    q = text[at : at + 1]
    if q in {'"', "'"}:
        if text.startswith(q * 3, at):
            end = text.find(q * 3, at + 3)
            if end >= 0:
                return at + 3, end, end + 3
        m = re.compile(r'"((?:[^"\\]|\\.)*)"' if q == '"' else r"'((?:[^']|'')*)'", re.S).match(text, at)
        if m and "\n\n" not in m[0]:
            return m.start(1), m.end(1), m.end()
    m = re.compile(rf"[ \t]+[{marks}][^\n]*|[ \t\r]+$").search(text, at, stop)
    end = m.start() if m else stop
    return at, len(text[:end].rstrip()) if end > at and text[end - 1].isspace() else end, stop


def _name(key: str) -> str:
    return key[1:-1] if key[:1] in {'"', "'"} else key.strip()


def _yaml(text: str) -> Iterator[Value]:
    stack: list[tuple[int, str]] = []  # indentation and key
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        after = stop + 1
        bare = line.strip()
        if not bare or bare.startswith("#"):
            at = after
            continue
        if bare in {"---", "..."}:
            stack.clear()
            at = after
            continue
        entry = _ENTRY.match(line)
        item = None if entry else _ITEM.match(line)
        if entry:
            lead, indent = len(entry[1]), len(entry[1]) + len(entry[2])
            while stack and (stack[-1][0] >= indent if not entry[2] else stack[-1][0] > lead):
                stack.pop()
            stack.append((indent, _name(entry[3])))
            start = at + entry.end()
        elif item:
            indent = lead = len(item[1])
            while stack and stack[-1][0] > lead:
                stack.pop()
            indent = len(item[1]) + len(item[2]) - 1
            start = at + item.end()
        else:
            # the rest of a plain value, or a value below its key
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= indent:
                stack.pop()
            start = at + indent
        parts = tuple(k for _, k in stack)
        start += len(_TAGS.match(text, start, stop)[0])
        rest = text[start:stop]
        if _BLOCK.match(rest):
            # each line of a block is a value of its own
            while after < len(text):
                end = text.find("\n", after)
                end = len(text) if end < 0 else end
                inner = text[after:end]
                if inner.strip():
                    depth = len(inner) - len(inner.lstrip())
                    if depth <= indent:
                        break
                    yield parts, after + depth, after + len(inner.rstrip())
                after = end + 1
        elif rest[:1] in {"{", "["} and not rest.startswith("{{"):
            found, end = _flow(text, start, parts)
            yield from found
            end = text.find("\n", end)
            after = len(text) if end < 0 else end + 1
        elif rest.strip() and not rest.lstrip().startswith("#"):
            a, b, end = _scalar(text, start, stop, "#")
            yield parts, a, b
            if end > stop:
                end = text.find("\n", end)
                after = len(text) if end < 0 else end + 1
        at = after


def _lines(text: str) -> Iterator[Value]:
    """TOML, INI, properties and env files: sections, ``key = value`` or ``key: value``, and lines that go on."""
    section: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        after = stop + 1
        bare = line.strip()
        if not bare or bare[0] in "#;!":
            pass
        elif head := _SECTION.match(line):
            section = parts = tuple(a or b or c for a, b, c in _PARTS.findall(head[1]))
        elif line[0] in " \t" and len(parts) > len(section) and not _SETTING.match(line):
            a = at + len(line) - len(line.lstrip())
            yield parts, *_scalar(text, a, stop, "#;")[:2]
        elif m := _SETTING.match(line):
            parts = (*section, *(a or b or c for a, b, c in _PARTS.findall(m[1])))
            start = at + m.end()
            rest = text[start:stop]
            if rest[:1] in {"{", "["} and not rest.startswith("{{"):
                found, end = _flow(text, start, parts)
                yield from found
                end = text.find("\n", end)
                after = len(text) if end < 0 else end + 1
            elif rest.strip():
                a, b, end = _scalar(text, start, stop, "#;")
                if b > a and text[b - 1] == "\\" and end == stop:
                    b = len(text[:b - 1].rstrip())
                for piece in re.finditer(r"[^\n]+", text[a:b]):
                    x = piece[0].strip()
                    if x:
                        lead = a + piece.start() + len(piece[0]) - len(piece[0].lstrip())
                        yield parts, lead, lead + len(x)
                if end > stop:
                    end = text.find("\n", end)
                    after = len(text) if end < 0 else end + 1
        at = after


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z_][\w:.\-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.\-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_NAMING = {"name", "key", "id"}


def _xml(text: str) -> Iterator[Value]:
    """Texts of elements and values of attributes; ``<add key="a" value="b"/>`` and ``<key>a</key><string>b</string>`` give ``a``."""
    stack: list[str] = []
    named: dict[int, str] = {}  # by depth the text of a key element, until its value was read
    at = 0

    def value(start: int, end: int, tag: str | None) -> Iterator[Value]:
        body = text[start:end]
        if body.strip():
            lead = start + len(body) - len(body.lstrip())
            if tag == "key":
                named[len(stack) - 1] = body.strip()
            else:
                parts = (*stack[:-1], named.pop(len(stack) - 1)) if len(stack) - 1 in named else tuple(stack)
                yield parts, lead, start + len(body.rstrip())

    for m in _TAG.finditer(text):
        tag = stack[-1] if stack else None
        if m["name"] or m["data"] is not None:
            yield from value(at, m.start(), tag)
        if m["data"] is not None:
            yield from value(m.start("data"), m.end("data"), tag)
        elif m["name"] and m["close"]:
            if m["name"] in stack:  # those opened within it are closed too
                del stack[len(stack) - 1 - stack[::-1].index(m["name"]) :]
        elif m["name"]:
            stack.append(m["name"])
            pairs = [(a[1], a.start(2) if a[2] is not None else a.start(3), a.end(2) if a[2] is not None else a.end(3)) for a in _ATTRIBUTE.finditer(text, m.start("rest"), m.end("rest"))]
            name = next((text[b:c] for a, b, c in pairs if a.lower() in _NAMING), None)
            for a, b, c in pairs:
                if c > b and a.lower() not in _NAMING:
                    yield (*stack, *((name,) if name and a.lower() == "value" else (a,))), b, c
            if m["empty"]:
                stack.pop()
            elif name:
                stack.append(name)
        at = m.end()
    yield from value(at, len(text), stack[-1] if stack else None)
