"""From ranked chunks to the context of an answer: selection under a budget, class headers, and merging of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import estimate_tokens, symbol_parent

MAX_CHUNKS, MAX_PER_FILE, BUDGET = 12, 4, 12_000


def select_chunks(ranked: DataFrame, budget: int = BUDGET, max_chunks: int = MAX_CHUNKS, per_file: int = MAX_PER_FILE) -> DataFrame:
    """``(query_id, id, path, rank, tokens, position)``: two passes over each ranking, first one chunk per new file, then more.

    A chunk that would overrun the budget is skipped and later ones are tried; the first is always kept.  What is chosen
    depends on all choices before, so it is a fold over the ranking of one query, which has at most the search's ``k`` rows.
    """
    entry = F.struct("rank", "id", "path", "tokens")
    lists = ranked.select("query_id", "id", "path", "rank", "tokens").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("r"))
    passes = F.concat(F.transform("r", lambda x: F.struct(F.lit(1).alias("turn"), x.alias("c"))), F.transform("r", lambda x: F.struct(F.lit(2).alias("turn"), x.alias("c"))))
    kind = "array<struct<id:string,path:string,rank:int,tokens:bigint>>"
    start = F.struct(F.array().cast(kind).alias("chosen"), F.lit(0).cast("bigint").alias("used"))

    def step(state: Column, item: Column) -> Column:
        chosen, c = state["chosen"], item["c"]
        same = F.size(F.filter(chosen, lambda x: x["path"] == c["path"]))
        fits = (F.size(chosen) == 0) | (state["used"] + c["tokens"] <= budget)
        take = (F.size(chosen) < max_chunks) & ~F.exists(chosen, lambda x: x["id"] == c["id"]) & (same < per_file) & ((item["turn"] == 2) | (same == 0)) & fits
        one = F.struct(c["id"].cast("string").alias("id"), c["path"].cast("string").alias("path"), c["rank"].cast("int").alias("rank"), c["tokens"].cast("bigint").alias("tokens"))
        return F.when(take, F.struct(F.concat(chosen, F.array(one)).alias("chosen"), (state["used"] + c["tokens"]).alias("used"))).otherwise(state)

    done = lists.select("query_id", F.aggregate(passes, start, step).alias("s"))
    return done.select("query_id", F.posexplode("s.chosen").alias("pos", "c")).select("query_id", "c.id", "c.path", "c.rank", "c.tokens", (F.col("pos") + 1).alias("position"))


def add_class_headers(chosen: DataFrame, chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The header chunk of each chosen method's class, once, while the budget lasts: ``(query_id, id, rank, tokens)``.

    ``chosen`` has ``query_id, id, path, kind, symbol, rank, tokens, position``.
    """
    used = chosen.groupBy("query_id").agg(F.sum("tokens").alias("used"))
    methods = chosen.where("kind = 'method'").withColumn("parent", symbol_parent(F.col("symbol"))).where("parent is not null")
    first = Window.partitionBy("path", "symbol").orderBy("start_line", "end_line", "id")
    headers = chunks.where("kind = 'class'").withColumn("n", F.row_number().over(first)).where("n = 1")
    headers = headers.select("path", F.col("symbol").alias("parent"), F.col("id").alias("header"), estimate_tokens(F.col("text")).alias("cost"))
    wanted = methods.join(headers, ["path", "parent"]).groupBy("query_id", "header", "cost").agg(F.min("position").alias("position"), F.min_by("rank", "position").alias("rank"))
    missing = wanted.join(chosen.select("query_id", F.col("id").alias("header")), ["query_id", "header"], "left_anti").join(used, "query_id")
    lists = missing.groupBy("query_id").agg(F.first("used").alias("used"), F.array_sort(F.collect_list(F.struct("position", "header", "cost", "rank"))).alias("h"))
    start = F.struct(F.array().cast("array<struct<id:string,rank:int,tokens:bigint>>").alias("kept"), F.col("used").cast("bigint").alias("used"))

    def step(state: Column, h: Column) -> Column:
        one = F.struct(h["header"].cast("string").alias("id"), h["rank"].cast("int").alias("rank"), h["cost"].cast("bigint").alias("tokens"))
        return F.when(state["used"] + h["cost"] <= budget, F.struct(F.concat(state["kept"], F.array(one)).alias("kept"), (state["used"] + h["cost"]).alias("used"))).otherwise(state)

    return lists.select("query_id", F.explode(F.aggregate("h", start, step)["kept"]).alias("k")).select("query_id", "k.*")


def merge_spans(spans: DataFrame, key: str = "query_id", texts: bool = False) -> DataFrame:
    """Overlapping or touching spans of a file become one: gaps and islands over lines.

    ``spans`` has ``key, path, id, start_line, end_line, symbol, kind, score, rank, context``.  Returns ``key, path, start_line,
    end_line, symbols, kinds, score, rank, role, chunk_ids``; a span of context chunks alone has role ``context``.

    With ``texts``, ``spans`` also has ``language, text``: the result has the language of a span's first chunk and what
    ``merged_text`` gives of it, without an exchange by lines, and no span without lines.
    """
    order = [F.col("start_line"), F.col("end_line"), F.col("id")]
    within = Window.partitionBy(key, "path").orderBy(*order)
    reach = F.max("end_line").over(within.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0)
    island = F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("opens", opens).withColumn("island", island)
    more = [F.col("language"), F.col("text")] if texts else []
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col("symbol"), F.col("kind"), *more)))
    out = marked.groupBy(key, "path", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), ordered.alias("parts"), F.max("score").alias("score"), F.min("rank").alias("rank"), F.bool_and("context").alias("context")
    )
    if texts:
        text = _laid_over(F.col("parts"), F.col("start_line"), F.col("end_line"))
        # a filter would work it out a second time
        out = out.select("*", F.get("parts", F.lit(0))["language"].alias("language"), F.explode(F.array_compact(F.array(text))).alias("text"))
    return out.select(
        key, "path", "start_line", "end_line",
        F.array_distinct(F.filter(F.transform("parts", lambda p: p["symbol"]), lambda s: s.isNotNull() & (s != ""))).alias("symbols"),
        F.array_distinct(F.transform("parts", lambda p: p["kind"])).alias("kinds"),
        "score", "rank", F.when(F.col("context"), "context").otherwise("match").alias("role"), F.transform("parts", lambda p: p["id"]).alias("chunk_ids"), *(["language", "text"] if texts else []),
    )


def _laid_over(parts: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last`` of ordered parts, a later part's line over an earlier one's; null without any."""
    whole = F.get(parts, F.lit(0))
    size = last - whole["start_line"] + 1
    lines = F.split(whole["text"], "\n", -1)
    one = F.when(F.size(lines) <= size, whole["text"]).when(size > 0, F.array_join(F.slice(lines, F.lit(1), F.greatest(size, F.lit(1))), "\n"))
    cut = F.filter(F.transform(parts, lambda p: F.struct(p["start_line"].alias("at"), F.split(p["text"], "\n", -1).alias("lines"))), lambda p: p["at"].isNotNull() & p["lines"].isNotNull())
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a lambda's variable isn't worked out again for each use

    def own(p: Column, later: Column) -> Column:
        placed = F.transform(p["lines"], lambda line, k: F.struct((p["at"] + k).alias("n"), line.alias("line")))
        return F.filter(placed, lambda x: x["n"].between(first, last) & ~F.exists(later, lambda q: x["n"].between(q["at"], q["at"] + F.size(q["lines"]) - 1)))

    kept = once(cut, lambda c: F.array_sort(F.flatten(F.transform(c, lambda p, n: once(F.slice(c, n + 2, F.size(c)), lambda later: own(p, later))))))
    gaps = once(kept, lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: x["line"]), "\n")))

    def lay(done: Column, p: Column) -> Column:
        before = p["at"] - first
        rest = F.slice(done, before + F.size(p["lines"]) + 1, F.size(done))
        return F.when(F.size(done) >= before, F.concat(F.slice(done, F.lit(1), before), p["lines"], rest))

    # lists of lines are laid over one another; where a line is missing between them, lines are looked at one by one
    laid = once(F.aggregate(cut, F.array().cast("array<string>"), lay), lambda x: F.when((F.size(x) > 0) & (last >= first), F.array_join(F.slice(x, F.lit(1), last - first + 1), "\n")))
    return F.when(F.size(parts) == 1, one).otherwise(F.coalesce(laid, gaps))


def merged_text(spans: DataFrame, merged: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, path, start_line, text)`` of merged spans: the lines of their chunks, a later chunk's line over an earlier one's."""
    lines = spans.select(key, "path", "start_line", "end_line", "id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("n", F.col("start_line") + F.col("pos"))
    one = lines.groupBy(key, "path", "n").agg(F.max_by("line", F.struct("start_line", "end_line", "id")).alias("line"))
    inside = merged.select(key, "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    placed = one.join(inside, [key, "path"]).where("n between s and e")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return placed.groupBy(key, "path", F.col("s").alias("start_line")).agg(text.alias("text"))


def within_budget(sources: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """The sources of each query in order up to the first that overruns the budget; the first is always kept."""
    order = Window.partitionBy(key).orderBy("rank", "path", "start_line")
    running = sources.withColumns({"at": F.row_number().over(order), "running": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # later small sources don't return once one was too much: the running sum only grows
    return running.where((F.col("at") == 1) | (F.col("running") <= budget)).drop("running").withColumnRenamed("at", "position")


def overview_sources(map_tokens: int, readme_tokens: int, sources: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Retrieved sources that still fit after a repository map and its readme are put before them."""
    return within_budget(sources, budget - map_tokens - readme_tokens)
