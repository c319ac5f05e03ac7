"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import consensus, credentials, languages, mixing, near_duplicates, packing, pairs, source_kinds, splitting
from quillon.session import stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "chunks"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "chunks"))


CLAIM_CLASSES = ("supported", "unsupported", "contradicted", "not a claim")
ANSWER_CLASSES = ("supported", "partially_supported", "unsupported")


def _claim_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.usable_votes(table(spark, sf_dir, "claims"), ["answer", "claim"], "grader", "support", "graded_at", "label_id", CLAIM_CLASSES)


def _answer_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.usable_votes(table(spark, sf_dir, "judgements"), ["answer"], "judge", "verdict", "judged_at", "judgement_id", ANSWER_CLASSES)


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = consensus.consensus(_claim_votes(spark, sf_dir), ["answer", "claim"], CLAIM_CLASSES)
    answers = consensus.consensus(_answer_votes(spark, sf_dir), ["answer"], ANSWER_CLASSES)
    columns = ["target", "answer", "claim", "label", "confidence", "n_votes", "agreement"]
    claims = claims.withColumn("target", F.lit("claim")).select(columns)
    return claims.unionByName(answers.withColumns({"target": F.lit("answer"), "claim": F.lit(0)}).select(columns))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_consensus(spark, sf_dir).select("target", "answer", "claim", "label")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = consensus.reliability(_claim_votes(spark, sf_dir), ["answer", "claim"], CLAIM_CLASSES).withColumn("target", F.lit("claim"))
    return claims.unionByName(consensus.reliability(_answer_votes(spark, sf_dir), ["answer"], ANSWER_CLASSES).withColumn("target", F.lit("answer")))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = consensus.overall_agreement(_claim_votes(spark, sf_dir), ["answer", "claim"]).withColumn("target", F.lit("claim"))
    return claims.unionByName(consensus.overall_agreement(_answer_votes(spark, sf_dir), ["answer"]).withColumn("target", F.lit("answer")))


def p4_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_credentials(spark, sf_dir).where("id is not null").select("id", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("id", "path", "text")
    return credentials.redact_credentials(chunks)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p5_pieces_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cut chunk: whether its pieces begin and end with it, leave no gap, keep the limits and have the right lines."""
    pieces = p5_pieces(spark, sf_dir).where("id is not null")
    whole = table(spark, sf_dir, "chunks").where("id is not null").select("id", F.coalesce("start_line", F.lit(1)).alias("base"), F.col("text").alias("whole")).distinct()
    order = Window.partitionBy("id").orderBy("piece")
    rows = pieces.withColumns({"before": F.lag("end_char").over(order), "last": F.max("end_char").over(Window.partitionBy("id"))}).join(whole, "id")
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    joined = (F.coalesce("before", F.lit(0)) >= F.col("start_char") - 1) & ((F.col("piece") > 1) | (F.col("start_char") == 0)) & (F.col("last") == F.length("whole"))
    within = (F.length("text") <= splitting.MAX_CHARS) & (breaks(F.col("text")) < splitting.MAX_LINES)
    slices = F.col("text") == F.substring("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    lines = (F.col("start_line") == F.col("base") + breaks(F.substring("whole", F.lit(1), F.col("start_char")))) & (F.col("end_line") == F.col("start_line") + breaks(F.col("text")))
    return rows.groupBy("id").agg(F.bool_and(joined).alias("joined"), F.bool_and(within).alias("within"), F.bool_and(slices).alias("slices"), F.bool_and(lines).alias("lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("id is not null").select("id").distinct()


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_kinds.source_kinds(table(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_files(spark, sf_dir).where("reason is not null").select("repo_id", "path")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "answer_results")).where("result_id is not null")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_windows"))


def p7_places_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each window: how many texts are placed, and whether each is placed once, whole if it fits, in windows that aren't overfull."""
    packed = stored(p7_packed(spark, sf_dir))
    used = packed.groupBy("window_name", "capacity", "container").agg(F.sum("size").alias("used")).groupBy("window_name").agg(F.max((F.col("used") > F.col("capacity")).cast("int")).alias("over"))
    per = packed.groupBy("window_name", "capacity", "doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("tokens"))
    whole = per.groupBy("window_name").agg(F.count("*").alias("texts"), F.bool_and(F.col("parts") == F.ceil(F.col("tokens") / F.col("capacity"))).alias("whole"))
    return whole.join(used, "window_name").select("window_name", "texts", "whole", (F.col("over") == 0).alias("fits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_caps_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source with a target and texts: whether no text is used more often than allowed and the share is within 0.001."""
    shares = p8_shares(spark, sf_dir).where("target_share > 0 and tokens > 0")
    known = shares.agg(F.sum("target_share").alias("known"))  # one row
    near = F.abs(F.col("reached_share") - F.col("target_share") / F.col("known")) <= 0.001
    return shares.crossJoin(known).select("source", (F.col("most_repeats") <= F.coalesce("max_repeats", F.lit(1))).alias("within"), near.alias("near"))


def p8_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), policy="all")[1]


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = languages.corrected_languages(p9_segments(spark, sf_dir)).where("id is not null")
    return rows.select(F.col("id").alias("doc_id"), "language")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


LINKED = """w as (select distinct id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) k from chunks), n as (select id, count(*) n, md5(string_agg(k, ' ' order by k)) c from w group by id having count(*) >= 25), b as (select w.id, k from w join n using (id)),
 i as (select a.id id_a, b.id id_b, count(*) s from b a join b using (k) where a.id < b.id group by 1, 2), pr as (select id_a, id_b from i join n x on x.id = id_a join n y on y.id = id_b where 5 * s >= 4 * (x.n + y.n - s))"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say over whole tables; the other operators are tested against brute force and exact round trips."""

    def agreement(target: str, source: str, keys: str, who: str, label: str, at: str, row: str, classes: tuple[str, ...], joint: str) -> str:
        names = ", ".join(f"'{c.replace('_', ' ')}'" for c in classes)
        return f"""select '{target}' as target, items, n as pairable_votes, round(ob, 6) as observed, round(ex, 6) as expected, round(case when ex < 1 then 1 - (1 - ob) / (1 - ex) end, 6) as alpha from (
 with r as (select {keys}, {who} as w, regexp_replace(regexp_replace(lower({label}), '^\\s+|\\s+$', '', 'g'), '[\\s_\\-./]+', ' ', 'g') as l, {at} as t, {row} as i from {source}),
 v as (select {keys}, w, l from r where l in ({names}) and {joint} and w is not null qualify row_number() over (partition by {keys}, w order by t desc nulls last, i desc, l desc) = 1),
 p as (select {keys}, l, count(*) c from v group by all), z as (select {keys}, sum(c) m, sum(c * (c - 1)) s from p group by {keys} having sum(c) >= 2),
 k as (select l, sum(c) n from p join z using ({keys}) group by l), e as (select sum(n) n, sum(n * (n - 1)) al from k), o as (select count(*) items, sum(m) tm, sum(s / (m - 1)) sm from z)
 select items, tm n, sm / tm ob, al / (n * (n - 1)) ex from o, e)"""

    return {
        "p1_found": f"with {LINKED} select id_a, id_b from pr",
        "p1_groups": f"""with recursive {LINKED}, e as materialized (select id_a a, id_b b from pr union all select id_b, id_a from pr), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
 g as (select a id, min(b) lowest from r group by a), ln as (select e.a id, count(distinct y.c) filter (y.c <> x.c) links from e join n x on x.id = e.a join n y on y.id = e.b group by e.a)
 select n.id, least(n.id, coalesce(lowest, n.id)) as group_id, count(*) over (partition by c) as copies, coalesce(links, 0) as links from n left join g on g.id = n.id left join ln on ln.id = n.id""",
        "p2_agreement": agreement("claim", "claims", "answer, claim", "grader", "support", "graded_at", "label_id", CLAIM_CLASSES, "answer is not null and claim is not null")
        + " union all "
        + agreement("answer", "judgements", "answer", "judge", "verdict", "judged_at", "judgement_id", ANSWER_CLASSES, "answer is not null"),
        "p5_pieces_hold": "select distinct id, true as joined, true as within, true as slices, true as lines from chunks where length(text) > 6000 or length(text) - length(replace(text, chr(10), '')) + 1 > 120",
        "p7_places_hold": "select window_name, count(distinct doc_id) as texts, true as whole, true as fits from context_windows, documents where length(text) > 0 group by window_name",
        "p8_caps_hold": "select distinct source, true as within, true as near from mix_targets join documents using (source) where target_share > 0 and length(text) > 0",
        "p5_found": "select distinct id from chunks where length(text) > 6000 or length(text) - length(replace(text, chr(10), '')) + 1 > 120",
    }
