import re

import pytest

from quillon.operators import chunking
from quillon.operators.structure import chunk_text, heading_sections, window_ranges

PYTHON = '''"""Users."""
import os

LIMIT = 3  # trailing


# Handles users.
class UserService:
    """Service."""

    def __init__(self, db):
        self.db = db

    # Creates one.
    def create_user(self, name):
        text = """
    def not_a_function(): pass
"""
        return self.db.add(name, text)

    @staticmethod
    def normalize(name):
        return name.strip()


async def main():
    await run()
'''
JAVASCRIPT = """import x from './x';

// Adds.
export function add(a, b) {
  return `${a} { ${b}`;
}

export const Memo = React.memo(() => {
  return 1;
});

class Btn extends Base {
  state = {};
  onClick = () => {
    this.go('}');
  };
  render() {
    return null;
  }
}

export default () => 1;
"""
TYPESCRIPT = """export interface Item {
  id: number;
}
export type Id = string | number;
enum Color { Red, Blue }
export abstract class Store<T> {
  private items: T[] = [];
  public add(item: T): void {
    this.items.push(item);
  }
}
const helper = async (x: number): Promise<number> => x + 1;
"""
JAVA = """package a;

import b.C;

/** Orders. */
@Service
public class OrderService {
    private final Repo repo;

    public OrderService(Repo repo) {
        this.repo = repo;
    }

    @Override
    public List<Order> find(String q) throws Exception {
        if (q == null) { return List.of(); }
        return repo.find(q);
    }

    interface Hook {
        void run();
    }
}
"""
GO = """package main

import "fmt"

// Server serves.
type Server struct {
	addr string
}

// Start starts it.
func (s *Server) Start() error {
	fmt.Println("}")
	return nil
}

func main() {
	s := &Server{}
	s.Start()
}
"""
MARKDOWN = "intro line\n\n# A\n\n## B\ntext b\n\n```\n# not a heading\n```\n\n## C\n\n# D\ntail\n"
TEXTS = {"python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "java": JAVA, "go": GO, "markdown": MARKDOWN}


@pytest.mark.parametrize("language", TEXTS)
@pytest.mark.parametrize("max_lines", [3, 6, 12, 120])
def test_every_line_with_a_word_is_in_a_chunk_and_chunks_are_slices(language, max_lines):
    lines = TEXTS[language].split("\n")
    seen = set()
    for p in chunk_text(TEXTS[language], language, max_lines, 5, 2):
        assert p.text == "\n".join(lines[p.start : p.end + 1]) and p.end - p.start + 1 <= max(max_lines, 5)
        seen |= set(range(p.start, p.end + 1))
    assert {i for i, x in enumerate(lines) if re.search(r"\w", x)} <= seen


def names(text, language, max_lines=120):
    return [(p.kind, p.symbol) for p in chunk_text(text, language, max_lines)]


def test_python():
    assert names(PYTHON, "python") == [("module", None), ("class", "UserService"), ("function", "main")]
    small = [(p.kind, p.symbol, p.text.split("\n")[0].strip()) for p in chunk_text(PYTHON, "python", 8)]
    assert ("method", "UserService.create_user", "# Creates one.") in small
    assert ("method", "UserService.normalize", "@staticmethod") in small
    assert not any(s == "not_a_function" for _, s, _ in small)


def test_long_function_becomes_windows_with_its_name():
    body = "def long():\n" + "\n".join(f"    x{i} = {i}" for i in range(199))
    assert [(p.start + 1, p.end + 1, p.symbol) for p in chunk_text(body, "python")] == [(1, 60, "long"), (51, 110, "long"), (101, 160, "long"), (151, 200, "long")]


def test_comment_and_blank_line_stay_a_module_chunk():
    assert [(p.kind, p.start, p.end) for p in chunk_text("# note\n\ndef f():\n    pass\n", "python")] == [("module", 0, 0), ("function", 2, 3)]


def test_text_that_does_not_parse_still_yields_its_definitions():
    found = names("def ok():\n    return 1\n\ndef broken(:\n    pass\n\nclass Fine:\n    def m(self):\n        pass\n", "python")
    assert ("function", "ok") in found and ("class", "Fine") in found


def test_javascript():
    found = names(JAVASCRIPT, "javascript", 6)
    assert {("function", "add"), ("function", "Memo"), ("method", "Btn.onClick"), ("method", "Btn.render"), ("function", "default")} <= set(found)


def test_typescript():
    assert {("type", "Item"), ("type", "Id"), ("type", "Color"), ("class", "Store"), ("function", "helper")} <= set(names(TYPESCRIPT, "typescript"))


def test_java():
    found = set(names(JAVA, "java", 8))
    assert {("method", "OrderService.OrderService"), ("method", "OrderService.find"), ("type", "OrderService.Hook")} <= found


def test_go():
    chunks = chunk_text(GO, "go")
    assert [(p.kind, p.symbol) for p in chunks if p.symbol] == [("type", "Server"), ("method", "Server.Start"), ("function", "main")]
    assert next(p for p in chunks if p.symbol == "Server.Start").text.startswith("// Start starts it.")


def test_headings():
    lines = MARKDOWN.rstrip("\n").split("\n")
    assert [t for _, _, t in heading_sections(lines)] == [None, "A", "A > B", "A > C", "D"]
    chunks = chunk_text(MARKDOWN, "markdown")
    assert [c.symbol for c in chunks] == [None, "A > B", "D"]  # headings alone are carried into the next section


def test_window_ranges():
    assert window_ranges(0, 129, 60, 10) == [(0, 59), (50, 109), (100, 129)]
    assert window_ranges(0, 0, 60, 10) == [(0, 0)]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            window_ranges(0, 9, *bad)


def test_blank_and_strange_texts():
    assert chunk_text("", "python") == [] and chunk_text(" \n\n", "go") == []
    assert chunk_text("}}}}{{{", "java") == []
    assert chunk_text("word }}}}{{{", "java")[0].kind == "window"
    assert chunk_text("def f():\n\tx = '" + "a" * 100_000 + "'", "python")[0].symbol == "f"


def test_window_chunks_and_coverage(spark):
    text = "\n".join(f"line {i}" for i in range(130)) + "\n\n  \n"
    files = spark.createDataFrame([("r", "a.txt", None, text, "h"), ("r", "b.txt", None, " \n", "h"), ("r", "c.txt", None, None, "h")], "repo_id string, path string, language string, text string, file_hash string")
    rows = chunking.window_chunks(files)
    assert [(r["start_line"], r["end_line"]) for r in rows.orderBy("start_line").collect()] == [(1, 60), (51, 110), (101, 130)]
    assert [tuple(r)[2:] for r in chunking.coverage(files, rows).collect()] == [(130, 130)]
    assert chunking.with_ids(rows.unionByName(rows)).count() == 3
    assert chunking.structured_chunks(files.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.window_chunks(files, 5, 5)
