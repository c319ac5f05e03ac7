"""A directory tree as a Spark data source: one partition per top-level entry, with pruning before anything is listed.

Spark's own file sources leave out names that begin with a dot or an underscore, so a tree of source code can't be read
with them.  ``spark.dataSource.register(RepositorySource)``, then ``spark.read.format("repository").load(root)``.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that hold no source of one's own (fixed values).
DENIED_DIRS = {
    ".git", ".hg", ".svn", "node_modules", "bower_components", "dist", "build",
    "__pycache__", ".venv", "venv", ".tox", ".next", ".nuxt", ".turbo",
    ".vite", ".cache", ".idea", ".vscode", ".gradle", ".terraform", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "coverage", "vendor", ".quillon",
}
MAX_READ = 1_000_000
SCHEMA = "path string, size long, file_hash string, text string, skipped string"


@dataclass
class IgnoreRule:
    pattern: re.Pattern[str]
    negated: bool
    directories_only: bool


def ignore_rules(text: str) -> list[IgnoreRule]:
    """The rules of an ignore file; later rules win, ``!`` takes back."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip() if not line.rstrip().endswith("\\") else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated or line.startswith("\\") else line
        only_dirs = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        out, i = "", 0
        while i < len(body):
            c = body[i]
            if body.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out, i = out + "/.+", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := body.find("]", i + 2)) > 0:
                inner = body[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            elif c == "\\" and i + 1 < len(body):
                out, i = out + re.escape(body[i + 1]), i + 2
            else:
                out, i = out + re.escape(c), i + 1
        rules.append(IgnoreRule(re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, only_dirs))
    return rules


def ignored(rules: Sequence[IgnoreRule], path: str, is_dir: bool) -> bool:
    """Whether the last rule that matches a path, relative to its ignore file, leaves it out."""
    out = False
    for r in rules:
        if (is_dir or not r.directories_only) and r.pattern.match(path):
            out = not r.negated
    return out


def walk(root: str, below: str | None = None) -> Iterator[tuple]:
    """Rows of files in sorted order: links, denied and ignored entries are named with the reason and not entered."""
    chain: list[tuple[str, list[IgnoreRule]]] = []

    def visit(rel: str, above: list[tuple[str, list[IgnoreRule]]], only: str | None) -> Iterator[tuple]:
        here = os.path.join(root, rel)
        rules = above
        ignore = os.path.join(here, ".gitignore")
        if os.path.isfile(ignore) and not os.path.islink(ignore):
            with open(ignore, encoding="utf-8", errors="replace") as f:
                rules = [*above, (rel, ignore_rules(f.read()))]
        with os.scandir(here) as entries:
            found = sorted(entries, key=lambda e: e.name)
        for e in found:
            if only is not None and e.name != only:
                continue
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            inside = [(r, path[len(base) + 1 :] if base else path) for base, r in rules]
            if e.is_symlink():
                yield path, None, None, None, "symlink"
            elif is_dir and e.name in DENIED_DIRS:
                yield path, None, None, None, "denied_dir"
            elif any(ignored(r, p, is_dir) for r, p in inside):
                yield path, None, None, None, "gitignored"
            elif is_dir:
                yield from visit(path, rules, None)
            elif e.is_file(follow_symlinks=False):
                yield load(e.path, path)

    yield from visit("", chain, below)


def load(file: str, path: str) -> tuple:
    """One file: text decoded with replacement, byte order mark dropped, line ends as line feeds; null if unreadable, too large or binary."""
    try:
        size = os.stat(file).st_size
        if size > MAX_READ:
            return path, size, None, None, "too_large"
        with open(file, "rb") as f:
            data = f.read()
    except OSError:
        return path, None, None, None, "unreadable"
    digest = hashlib.sha256(data).hexdigest()
    if b"\0" in data[:8192]:
        return path, size, digest, None, "binary"
    return path, size, digest, data.decode("utf-8-sig", errors="replace").replace("\r\n", "\n"), None


class _Part(InputPartition):
    pass


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "RepositoryReader":
        return RepositoryReader(self.options["path"])


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = os.path.realpath(root)
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)

    def partitions(self) -> list[InputPartition]:
        return [_Part(name) for name in sorted(os.listdir(self.root))] or [_Part(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from walk(self.root, partition.value)


class GitSourceError(Exception):
    """An address that is not accepted, or a command that failed."""


def clone_dir(base: str, url: str) -> str:
    name = re.sub(r"\.git$", "", url.rstrip("/").replace(":", "/").rsplit("/", 1)[-1])
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("-"):
        raise GitSourceError(f"no repository name in {url!r}")
    return os.path.join(base, f"{name}-{hashlib.sha1(url.encode()).hexdigest()[:8]}")


def sync_repository(url: str, base: str, branch: str | None = None, runner: Callable = subprocess.run, timeout: int = 600) -> str:
    """A shallow clone of an address, or its update; never asks, never runs hooks, never deletes.  Returns the directory."""
    if not re.match(r"(?:https://|ssh://|[\w.-]+@[\w.-]+:)", url) or re.search(r"\s|\.\.|^-", url) or re.match(r"https://[^/]*@", url):
        raise GitSourceError(f"not an accepted address: {url!r}")
    if branch is not None and not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_./-]*", branch):
        raise GitSourceError(f"not a branch name: {branch!r}")
    target = clone_dir(base, url)
    safe = ["git", "-c", "core.hooksPath=/dev/null", "-c", "protocol.ext.allow=never", "-c", "filter.lfs.smudge=", "-c", "filter.lfs.required=false"]
    if os.path.isdir(os.path.join(target, ".git")):
        steps = [[*safe, "-C", target, "fetch", "--depth", "1", "origin", branch or "HEAD"], [*safe, "-C", target, "reset", "--hard", "FETCH_HEAD"]]
    else:
        steps = [[*safe, "clone", "--depth", "1", *(["--branch", branch] if branch else []), "--", url, target]]
    for step in steps:
        try:
            done = runner(step, capture_output=True, text=True, timeout=timeout, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
        except subprocess.TimeoutExpired as e:
            raise GitSourceError(f"git took longer than {timeout} seconds") from e
        if done.returncode:
            raise GitSourceError((done.stderr or "git failed").strip().splitlines()[-1])
    return target
