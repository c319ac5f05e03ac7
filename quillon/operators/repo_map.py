"""A map of a repository from its index: directories with their files, languages, purposes and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.describe import describe_file
from quillon.functions.text import estimate_tokens

README_NAMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")
README_LINES = 60
SYMBOLS_SHOWN, LANGUAGES_SHOWN = 4, 2


def directory_rows(files: DataFrame) -> DataFrame:
    """``(repo_id, directory, depth, files, direct_files, children)`` of every directory; each file is counted in all above it."""
    rows = files.select("repo_id", "path").distinct()
    above = rows.select("repo_id", "path", F.posexplode(paths.directories(F.col("path"))).alias("d", "directory"))
    below = above.withColumn("child", F.element_at(F.split("path", "/"), F.col("d") + 2)).withColumn("direct", F.size(F.split("path", "/")) == F.col("d") + 2)
    return below.groupBy("repo_id", "directory").agg(
        (F.first("d") + 1).alias("depth"), F.count("*").alias("files"), F.count_if("direct").alias("direct_files"), F.countDistinct(F.when(~F.col("direct"), F.col("child"))).alias("children")
    )


def map_directories(files: DataFrame) -> DataFrame:
    """Directories that a map lists: those that hold nothing but one directory give way to it; ``shown_depth`` counts only listed ones."""
    rows = directory_rows(files)
    listed = rows.where("not (direct_files = 0 and children = 1)")
    # the depth among the listed: how many listed directories lie above
    names = listed.select("repo_id", "directory", F.explode(paths.ancestors(F.concat("directory", F.lit("/x")))).alias("above"))
    depth = names.join(listed.select("repo_id", F.col("directory").alias("above")), ["repo_id", "above"]).groupBy("repo_id", "directory").agg(F.count("*").alias("shown_depth"))
    return listed.join(depth, ["repo_id", "directory"])


def directory_languages(files: DataFrame, shown: int = LANGUAGES_SHOWN) -> DataFrame:
    """``(repo_id, directory, languages)``: the most frequent languages below each directory, equal ones by their first path."""
    rows = files.where("language is not null").select("repo_id", "path", "language").distinct()
    each = rows.select("repo_id", "path", "language", F.explode(paths.directories(F.col("path"))).alias("directory"))
    counts = each.groupBy("repo_id", "directory", "language").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    order = Window.partitionBy("repo_id", "directory").orderBy(F.desc("n"), "first", "language")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "language"))), lambda x: x["language"]), ", ")
    return top.groupBy("repo_id", "directory").agg(names.alias("languages"))


def directory_symbols(outline: DataFrame, shown: int = SYMBOLS_SHOWN) -> DataFrame:
    """``(repo_id, directory, symbols)``: classes, types and functions that the files right in a directory define, the largest first."""
    kind_rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "type", 1).when(F.col("kind") == "function", 2)
    plain = F.col("symbol").isNotNull() & (F.col("symbol") != "") & ~F.col("symbol").contains(".") & ~F.col("symbol").startswith("_") & ~paths.is_test_path(F.col("path"))
    rows = outline.where(plain & kind_rank.isNotNull() & F.col("path").contains("/")).select("repo_id", F.regexp_extract("path", r"^(.*)/", 1).alias("directory"), "symbol", kind_rank.alias("k"), (F.coalesce("end_line", "start_line") - F.col("start_line")).alias("size"))
    one = rows.groupBy("repo_id", "directory", "symbol").agg(F.min(F.struct("k", (-F.col("size")).alias("s"))).alias("o"))
    order = Window.partitionBy("repo_id", "directory").orderBy("o", "symbol")
    top = one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown)
    return top.groupBy("repo_id", "directory").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "symbol"))), lambda x: x["symbol"]), ", ").alias("symbols"))


def test_directories(files: DataFrame) -> DataFrame:
    """``(repo_id, directory, files)`` of directories of tests that lie in no other such directory."""
    rows = directory_rows(files).where(paths.is_test_path(F.concat("directory", F.lit("/x")))).select("repo_id", "directory", "files")
    above = rows.select("repo_id", "directory", F.explode(paths.directories(F.col("directory"))).alias("above"))
    inner = above.join(rows.select("repo_id", F.col("directory").alias("above")), ["repo_id", "above"]).select("repo_id", "directory").distinct()
    return rows.join(inner, ["repo_id", "directory"], "left_anti")


def self_descriptions(heads: DataFrame) -> DataFrame:
    """``(repo_id, path, language, description)`` of files that describe themselves, from ``heads(repo_id, path, language, head)``."""
    return heads.withColumn("description", describe_file(F.col("head"), F.col("language"))).where("description is not null").drop("head")


def readmes(files: DataFrame) -> DataFrame:
    """``(repo_id, path, text, tokens)``: the first lines of the readme at the top of each repository."""
    order = F.array_position(F.array(*map(F.lit, README_NAMES)), F.col("path"))
    top = files.where(F.col("path").isin(*README_NAMES)).withColumn("o", order)
    one = top.groupBy("repo_id").agg(F.min_by(F.struct("path", "text"), F.struct("o", "text")).alias("f"))
    text = F.array_join(F.slice(F.split("f.text", "\n", -1), 1, README_LINES), "\n")
    return one.select("repo_id", "f.path", text.alias("text"), estimate_tokens(text).alias("tokens"))


#: Files whose description is that of their directory, the best first (fixed values), and how many entries a map shows.
NAMING = ("__init__.py", "doc.go", "mod.rs", "index.ts", "index.js", "README.md")
ROOT_FILES, DOCS_SHOWN, CODE_SHOWN, DOC_DEPTH = 12, 8, 10, 3
DIRECTORY_SHARE = 0.7


def directory_purposes(described: DataFrame) -> DataFrame:
    """``(repo_id, directory, purpose)``: what the naming file right in a directory says, from ``self_descriptions``."""
    place = F.array_position(F.array(*map(F.lit, NAMING)), paths.file_name(F.col("path")))
    rows = described.where(F.col("path").contains("/")).select("repo_id", F.regexp_extract("path", r"^(.*)/", 1).alias("directory"), "description", place.alias("place")).where("place > 0")
    return rows.groupBy("repo_id", "directory").agg(F.min_by("description", "place").alias("purpose"))


def notable_files(described: DataFrame, files: DataFrame) -> DataFrame:
    """``(repo_id, section, path, description, place)``: documents near the top and code that describes itself, shallow ones first."""
    top = F.size(F.split("path", "/")).alias("depth")
    rows = files.select("repo_id", "path").distinct().join(described.select("repo_id", "path", "description"), ["repo_id", "path"], "left")
    kind, plain = paths.kind_of(F.col("path")), ~paths.is_test_path(F.col("path")) & ~F.col("path").isin(*README_NAMES)
    doc, code = (kind == "doc") & (F.size(F.split("path", "/")) <= DOC_DEPTH), (kind == "code") & F.col("description").isNotNull() & ~paths.file_name(F.col("path")).isin(*NAMING)
    named = rows.where(plain).withColumn("section", F.when(doc, "docs").when(code, "code")).where("section is not null").select("*", top)
    order = Window.partitionBy("repo_id", "section").orderBy("depth", F.col("path").startswith("."), "path")
    limit = F.when(F.col("section") == "docs", DOCS_SHOWN).otherwise(CODE_SHOWN)
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("depth")


def _count(n: int) -> str:
    return f"{n} file{'' if n == 1 else 's'}"


def render_map(files: DataFrame, outline: DataFrame, repo_id: str, budget_tokens: int = 1500, heads: DataFrame | None = None) -> str:
    """The map of one repository as text within a budget; a report for one reader, its rows come from the operators above.

    ``heads`` (``repo_id, path, language, head``) adds what directories are for and files that describe themselves.  Directories take
    up to ``DIRECTORY_SHARE`` of the room, one that doesn't fit is passed over; the files after them end with the first that doesn't.
    """
    mine = files.where(F.col("repo_id") == repo_id)
    described = self_descriptions(heads.where(F.col("repo_id") == repo_id)) if heads is not None else None
    rows = map_directories(mine).join(directory_languages(mine), ["repo_id", "directory"], "left")
    rows = rows.join(directory_symbols(outline.where(F.col("repo_id") == repo_id)), ["repo_id", "directory"], "left")
    rows = rows.join(directory_purposes(described), ["repo_id", "directory"], "left") if described is not None else rows.withColumn("purpose", F.lit(None).cast("string"))
    total = mine.select("path").distinct().count()
    if not total:
        return "(the index is empty)"
    spoken = mine.where("language is not null").groupBy("language").agg(F.countDistinct("path").alias("n"), F.min("path").alias("first")).orderBy(F.desc("n"), "first").limit(6).collect()
    top = mine.where(~F.col("path").contains("/")).select("path").distinct()
    shown = [r["path"] for r in top.orderBy(~F.col("path").isin(*README_NAMES), F.col("path").startswith("."), "path").limit(ROOT_FILES).collect()]
    more = top.count() - len(shown)
    lines = ["Repository map (generated from the index; it is not a source file).", f"{_count(total)}: {', '.join(f'{r.language} {r.n}' for r in spoken)}." if spoken else f"{_count(total)}."]
    if shown:
        lines.append("Files at the top level: " + ", ".join(shown) + (f", and {more} more." if more else "."))
    lines.append("")
    room, used = budget_tokens * 4, sum(len(x) + 1 for x in lines)
    # no more directories than characters of the budget can be shown
    found = rows.where(~paths.is_test_path(F.concat("directory", F.lit("/x")))).orderBy("shown_depth", F.desc("files"), "directory").limit(room).collect()
    chosen = []
    for r in found:
        line = f"{'  ' * (r['shown_depth'] - 1)}{r['directory']}/  ({_count(r['files'])}{', ' + r['languages'] if r['languages'] else ''})" + (f" - {r['purpose']}" if r["purpose"] else "") + (f"  defines {r['symbols']}" if r["symbols"] else "")
        if not chosen or used + len(line) + 1 <= room * DIRECTORY_SHARE:
            chosen.append((r["directory"], line))
            used += len(line) + 1
    lines += [x for _, x in sorted(chosen)]
    tests = ", ".join(f"{r['directory']}/ ({_count(r['files'])})" for r in test_directories(mine).orderBy("directory").limit(room).collect())
    if tests:
        lines.append(f"Tests: {tests}.")
        used += len(lines[-1]) + 1
    if described is not None:
        notable = notable_files(described, mine).orderBy("section", "place").collect()  # at most DOCS_SHOWN + CODE_SHOWN rows
        for section, title in (("docs", "Documentation files (title or first heading):"), ("code", "Code files that describe themselves:")):
            entries = []
            for r in (r for r in notable if r["section"] == section):
                line = f"  {r['path']}" + (f" - {r['description']}" if r["description"] else "")
                if used + len(line) + 1 > room:
                    break
                entries.append(line)
                used += len(line) + 1
            lines += ["", title, *entries] if entries else []
    return "\n".join(lines)


LISTED = r"([\w.@+/-]+)/ {1,2}\(\d+ files?"


def lists_directory(text, directory):
    """Whether a rendered map names a directory, alone or as the beginning of a longer one."""
    wanted = F.regexp_replace(directory, "^/+|/+$", "")
    return F.exists(F.regexp_extract_all(text, F.lit(LISTED), F.lit(1)), lambda d: (d == wanted) | d.startswith(F.concat(wanted, F.lit("/"))))
