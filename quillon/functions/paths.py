"""File paths as columns: names, kinds, languages, and what a path or a question says about tests and release notes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings and whole names by language (fixed values).
CODE_EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".vue": "vue", ".svelte": "svelte",
}
DOC_EXTENSIONS = {".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".txt": "text"}
CONFIG_EXTENSIONS = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".rules": "rules", ".gradle": "gradle", ".xml": "xml"}
CONFIG_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", ".gitignore": "gitignore", ".env.example": "dotenv", ".env.sample": "dotenv", ".env.template": "dotenv"}

# Paths of tests and of release notes, and the words by which a question is about them (fixed values).
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|specs?|e2e|integration|fixtures|__mocks__)/|(^|/)(test_[^/]*|conftest\.py)$|_test\.[a-z]+$|\.(test|spec|itest)\.[a-z]+$"
CHANGELOG_PATH = r"(?i)(^|/)(changelog|changes|change[-_]?log|history|news|releases?|release[-_]?notes|whats[-_]?new|upgrading)([-_][0-9][a-zA-Z0-9_.-]*)?(\.(md|markdown|rst|txt))?$"
TEST_WORDS = ("test", "tests", "testing", "tested", "spec", "specs", "mock", "mocks", "fixture", "fixtures", "pytest", "vitest", "jest", "unittest")
CHANGE_WORDS = ("changelog", "changelogs", "release", "releases", "version", "versions", "history", "news", "upgrade", "upgrading", "changed", "change", "changes", "deprecated", "deprecation", "deprecations", "dropped", "introduced", "regression", "migrate", "migrating", "migration")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case with its dot; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def language_of(path: Column) -> Column:
    """The language of a file by its whole name, else by its ending; null if the type is not supported."""
    by_ending = _map({**CODE_EXTENSIONS, **DOC_EXTENSIONS, **CONFIG_EXTENSIONS})
    return F.coalesce(F.element_at(_map(CONFIG_NAMES), file_name(path)), F.element_at(by_ending, extension(path)))


def kind_of(path: Column) -> Column:
    """``code``, ``doc`` or ``config``; null if the type is not supported."""
    kinds = {**dict.fromkeys(CODE_EXTENSIONS, "code"), **dict.fromkeys(DOC_EXTENSIONS, "doc"), **dict.fromkeys(CONFIG_EXTENSIONS, "config")}
    return F.when(file_name(path).isin(*CONFIG_NAMES), F.lit("config")).otherwise(F.element_at(_map(kinds), extension(path)))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_changelog_path(path: Column) -> Column:
    return path.rlike(CHANGELOG_PATH)


def _mentions(question: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(question), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, wanted)))


def mentions_tests(question: Column) -> Column:
    return _mentions(question, TEST_WORDS)


def mentions_changes(question: Column) -> Column:
    return _mentions(question, CHANGE_WORDS)


def ancestors(path: Column) -> Column:
    """All directories above a file, shallowest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def directories(path: Column) -> Column:
    """``ancestors``, empty for a file at the top level."""
    return F.when(F.instr(path, "/") > 0, ancestors(path)).otherwise(F.array().cast("array<string>"))
