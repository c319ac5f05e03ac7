import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import source_kinds as sk


@pytest.mark.parametrize(
    "path, text, reason",
    [
        ("a/package-lock.json", "{}", "lock"), ("go.sum", "x v1 h1:a=", "lock"), ("poetry.lock", "x", "lock"),
        ("a.go", "// Code generated by tool v1. DO NOT EDIT.\npackage a", "generated"), ("a.ts", "/* @generated by tool */\nx", "generated"), ("a_pb2.py", "x = 1", "generated"), ("a.js", "x\n// end of tool output, source checksum b9823b5534890f829d9d49cae6a5acbc", "generated"), ("a.py", "# Diese Datei wurde automatisch aus x.xsd erzeugt, bitte nicht ändern.\nx = 1", "generated"),
        ("a.ts", "\n".join(f"export interface A{i} {{ a{i}: number; }}" for i in range(30)), "generated"),
        ("a.sh", "\n".join(f'run-step{i} --flag v{i} "${{x{i}}}"' for i in range(30)), None),
        ("a.py", "# Emits a 'DO NOT EDIT' banner into each output.\nx = 1", None), ("a.py", "# Writes the generated files for x; this file itself is edited by hand.\nx = 1", None), ("a.py", "# Checks that vendored copies of x are current.\nx = 1", None),
        ("a.js", "".join(f"function a{i}(b,c){{return b.d{i}(c)||e[{i}]}}" for i in range(90)), "minified"), ("a.min.css", ".a{b:c}" * 200, "minified"),
        ("a.py", "import x\nICON = '" + "Zm9v" * 900 + "'\n\ndef f(value):\n    return value.use(ICON)\n", None),
        ("a.py", "DATA = [\n" + "\n".join("    [" + ", ".join(str(i * j) for j in range(20)) + "]," for i in range(60)) + "\n]", "data"),
        ("a.md", "Do not edit this text without asking.", None), (None, None, None), ("a.py", "", None), ("settings.json", '{"a": 1}', None),
    ],
)
def test_reasons(path, text, reason):
    assert sk.file_reason(path, text) == reason


def test_places_and_notices():
    assert sk.says_vendored("third_party/x/a.py", "") and sk.says_vendored("lib/halyard-1.14.6.go", "") and sk.says_vendored("a.py", "# Vendored from x 1.2, with local fixes.\n")
    assert not sk.says_vendored("lib/vendor_portal/a.py", "x") and not sk.says_vendored("core/vendors/a.py", "x") and not sk.says_vendored("a.py", "# Checks that vendored copies of x are current.")


def test_fingerprints_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))).encode() for _ in range(40)]
    doc, mark = sk.fingerprints(texts)
    for i, t in enumerate(texts):
        alone = set(sk.fingerprints([t])[1].tolist())
        assert alone == set(mark[doc == i].tolist())
        assert bool(alone) == (len(t.split()) >= sk.GRAM)
    a = b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    assert set(sk.fingerprints([a])[1]) & set(sk.fingerprints([b"x y " + a + b" z"])[1])


def body(seed, n=80):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(10**6)}"
    shapes = (lambda: f"def {name()}({name()}):", lambda: f"    {name()} = {name()}({name()}, {name()})", lambda: f"    if {name()} and not {name()}:", lambda: f"        return [{name()} for {name()} in {name()}]", lambda: f"    {name()}.{name()}({name()})", lambda: f"    # {name()} {name()} {name()}")
    return "\n".join(rng.choice(shapes)() for _ in range(n))


def test_table(spark):
    library, function = body(1), body(2, 10)
    rows = [(f"r{i}", "util/x.py", library) for i in range(4)] + [(f"s{i}", "own.py", body(100 + i) + "\n" + function) for i in range(4)] + [("t", "solo.py", body(9)), ("t", "solo.py", body(9)), ("t", "gone.py", None), ("t", None, None), ("u", "go.sum", "")]
    df = spark.createDataFrame(rows, "repo_id string, path string, text string").withColumns({"reason": F.lit("clash"), "marked": F.lit(True)})
    got = {(r["repo_id"], r["path"]): r["reason"] for r in sk.source_kinds(df).collect()}
    assert len(got) == 12
    assert all(got[(f"r{i}", "util/x.py")] == "vendored" for i in range(4)) and all(got[(f"s{i}", "own.py")] is None for i in range(4))
    assert got[("t", "solo.py")] is None and got[("u", "go.sum")] == "lock" and got[("t", None)] is None
    assert sk.source_kinds(df.limit(0)).count() == 0


def test_edited_and_short_copies_in_many_repositories(spark):
    """Without a mark: every copy has its own edits; short copies have too few fingerprints; files of copied functions stay."""
    library, short, functions = body(1, 60).split("\n"), body(3, 5), [body(200 + i, 12) for i in range(6)]
    edited = ["\n".join(body(300 + i, 2) if k == 9 + 8 * i else line for k, line in enumerate(library)) for i in range(4)]
    assert len(sk.fingerprints([short.encode()])[1]) < sk.LEAST_PRINTS
    rows = [(f"r{i}", "util/x.py", t) for i, t in enumerate(edited)] + [(f"r{i}", "util/short.py", short.replace("\n", "\n\n") if i else short) for i in range(3)]
    rows += [(f"s{i}", "own.py", "\n".join(functions[(i + k) % 6] for k in range(3))) for i in range(6)]  # all of it from others, of which none is its origin
    rows += [(f"r{i}", "pkg/__init__.py", "from .x import a, b, c, d, e") for i in range(5)] + [(f"q{i}", "two.py", body(5)) for i in range(2)]
    rows += [("v", "vendor/y.py", body(6)), ("w", "lib/y.py", body(6)), ("v", "vendor/once.py", body(8))]
    df = spark.createDataFrame(rows, "repo_id string, path string, text string")
    assert {r["path"] for r in sk.source_kinds(df, marks=False).where("reason is null").collect()} == {"own.py", "pkg/__init__.py", "vendor/once.py"}
    got = {(r["repo_id"], r["path"]): r for r in sk.source_kinds(df).collect()}
    found = {k for k, r in got.items() if r["reason"] == "vendored"}
    assert found == {(f"r{i}", "util/x.py") for i in range(4)} | {(f"r{i}", "util/short.py") for i in range(3)} | {("v", "vendor/y.py"), ("w", "lib/y.py"), ("q0", "two.py"), ("q1", "two.py")}
    assert got["v", "vendor/once.py"]["reason"] == "third_party"
    assert got["r0", "util/x.py"]["shared_prints"] >= sk.LEAST_ALIKE and got["r0", "util/short.py"]["shared_prints"] == 1
    assert got["s0", "own.py"]["shared_prints"] == 0 and got["r0", "pkg/__init__.py"]["shared_prints"] is None


def test_notices_after_and_before_long_comments():
    licence = "\n".join(f"// line {i} of a licence that grants a right to copy, change and pass on this work under its terms" for i in range(70))
    block = "/*\n" + "\n".join(f"   line {i} of a licence that grants a right to copy, change and pass on this work" for i in range(70)) + "\n"
    code = body(7, 40)
    assert sk.file_reason("a.go", licence + "\n\n// Code generated by tool v1. DO NOT EDIT.\npackage a\n" + code) == "generated"
    assert sk.file_reason("a.java", block + "   This file was generated by tool.\n */\n" + code) == "generated"
    assert sk.file_reason("a.js", code + "\n// end of tool output\n" + licence) == "generated"
    assert sk.says_vendored("a.go", licence + "\n// Vendored from x 1.2, with local fixes.\npackage a") and sk.says_vendored("a.java", block + "   vendored from x 1.2\n */\n" + code)
    assert sk.file_reason("a.js", licence + "\n" + code) is None and not sk.says_vendored("a.js", licence + "\n" + code)
    far = code + "\n// the keys are generated by the server\n" + code + "\n// vendored from x\n" + code  # a remark amid the code isn't about the file
    assert sk.file_reason("a.js", far) is None and not sk.says_vendored("a.js", far)
