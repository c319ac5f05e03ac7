"""Answers from a language model as a batch: prompts, an injectable provider, scores and judging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import clip, code_fence, location, whole_word, symbol_leaf

#: Kinds of failure that end a run, because every later call would fail too.
FATAL = frozenset({"auth", "model_missing", "not_installed", "unreachable", "billing"})


class ProviderError(Exception):
    def __init__(self, message: str, kind: str = "other", retryable: bool = False):
        super().__init__(message)
        self.kind, self.retryable = kind, retryable


@dataclass(frozen=True)
class Reply:
    text: str
    finish: str = "stop"  # stop, length, refusal, other
    tokens_in: int | None = None
    tokens_out: int | None = None


class Provider(Protocol):
    sends_off_machine: bool

    def complete(self, system: str, message: str, max_tokens: int) -> Reply: ...


class ScriptedProvider:
    """Replies by a function of the message; needs no model."""

    sends_off_machine = False

    def __init__(self, reply: str | Callable[[str], str], finish: str = "stop"):
        self.reply, self.finish = reply, finish

    def complete(self, system: str, message: str, max_tokens: int) -> Reply:
        text = self.reply(message) if callable(self.reply) else self.reply
        return Reply(text, self.finish, len(system + message) // 4, len(text) // 4)


def format_sources(sources: DataFrame) -> DataFrame:
    """``(query_id, block)``: numbered sources of each question, best first, in fences that their text can't close."""
    text = F.replace(F.col("text"), F.lit("</sources>"), F.lit("<\\/sources>"))
    named = F.when(F.size("symbols") > 3, F.concat(F.slice("symbols", 1, 3), F.array(F.lit("...")))).otherwise(F.col("symbols"))
    label = F.when(F.col("role") == "context", F.trim(F.concat(F.lit("class header "), F.array_join(named, ", ")))).otherwise(F.trim(F.concat(F.array_join("kinds", "/"), F.lit(" "), F.array_join(named, ", "))))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.col("role") == "context", "path", "start_line"))
    rows = sources.withColumns({"number": number, "fence": code_fence(text), "safe": text, "label": label, "place": location(F.col("path"), F.col("start_line"), F.col("end_line"))})
    one = F.concat(F.format_string("[%d] %s - %s\n", "number", "place", "label"), F.col("fence"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("safe"), F.lit("\n"), F.col("fence"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", one.alias("b")))), lambda x: x["b"])
    return rows.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("block"))


def answer_message(block: Column, question: Column) -> Column:
    return F.concat(F.lit("<sources>\n"), block, F.lit("\n</sources>\n\nQuestion: "), F.trim(question))


def condense_message(turns: DataFrame) -> DataFrame:
    """``(conv_id, message)`` that asks to make the last question of a conversation stand alone, from its earlier turns."""
    one = F.concat(F.lit("User: "), clip(F.col("question"), 300), F.lit("\nAssistant: "), clip(F.col("answer"), 600))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"])
    return turns.groupBy("conv_id").agg(F.concat(F.lit("<conversation>\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n\n</conversation>")).alias("message"))


def standalone_question(original: Column, reply: Column, finish: Column, turns: Column, longest: int = 400) -> Column:
    """``struct<question, note>``: the rewriting, or the question as typed with the reason why it was kept."""
    from quillon.functions.text import clean_rewrite

    clean = clean_rewrite(reply)
    note = F.when(turns == 0, "no history").when(finish != "stop", "cut off").when(reply.isNull() | (clean == ""), "empty").when(F.length(clean) > longest, "too long")
    return F.struct(F.when(note.isNull(), clean).otherwise(original).alias("question"), note.alias("note"))


def last_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` answered turns of each conversation (``conv_id, turn, question, answer``)."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.where("answer is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def complete(prompts: DataFrame, provider: Provider, keep: Sequence[str], system: str, message_col: str = "message", max_tokens: int = 1000, consent: bool = False) -> DataFrame:
    """``(*keep, reply, finish, tokens_in, tokens_out, error)``: one call per row in Arrow batches.

    Failures become an ``error``; kinds that would fail every call end the job.  A provider that sends data off the machine is
    refused without ``consent``, before any call.  A null message is answered with ``no_context`` and no call.
    """
    if provider.sends_off_machine and not consent:
        raise PermissionError("this provider sends text off the machine; pass consent=True to allow it")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for message in b["_message"]:
                if message is None:
                    rows.append((None, "no_context", None, None, None))
                    continue
                try:
                    r = provider.complete(system, message, max_tokens)
                    rows.append((r.text, r.finish, r.tokens_in, r.tokens_out, None))
                except ProviderError as e:
                    if e.kind in FATAL:
                        raise
                    rows.append((None, None, None, None, f"{e.kind}: {e}"))
            out = pd.DataFrame(rows, columns=["reply", "finish", "tokens_in", "tokens_out", "error"], index=b.index)
            yield pd.concat([b[list(keep)], out.astype({"tokens_in": "Int64", "tokens_out": "Int64"})], axis=1)

    types = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keep)
    return prompts.select(*keep, F.col(message_col).alias("_message")).mapInPandas(run, f"{types}, reply string, finish string, tokens_in long, tokens_out long, error string")


def judge_by_rule(claims: DataFrame) -> DataFrame:
    """Claims without citations are unsupported by rule (``label``, ``by``); for the others both stay null and a model is asked."""
    bare = F.coalesce(F.length(F.trim("cites")), F.lit(0)) == 0
    return claims.withColumns({"label": F.when(bare, "unsupported"), "by": F.when(bare, "rule")})


def symbol_in_sources(symbols: Column, texts: Column) -> Column:
    """Whether any symbol's last part stands alone in any text; null without symbols."""
    hit = F.exists(symbols, lambda s: F.exists(texts, lambda t: F.rlike(t, whole_word(symbol_leaf(s)))))
    return F.when(F.size(symbols) > 0, hit)


def is_relevant(role: Column, path: Column, text: Column, kind: Column, files: Column, dirs: Column, symbols: Column) -> Column:
    """Whether a cited source bears on a question: its file, its directory or a symbol is gold; a map counts for overviews."""
    inside = F.exists(dirs, lambda d: path.startswith(F.concat(F.regexp_replace(d, "^/+|/+$", ""), F.lit("/"))))
    named = F.coalesce(symbol_in_sources(symbols, F.array(text)), F.lit(False))
    return F.when(role == "map", (kind == "overview") | (F.size(dirs) > 0)).otherwise(F.array_contains(files, path) | inside | named)


def turn_pairs(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, question, answer)`` of a transcript ``(conv_id, turn, role, text)``: each user turn with the reply right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    next_role, next_text = F.lead("role").over(order), F.lead("text").over(order)
    rows = messages.where("role in ('user', 'assistant')").withColumns({"answer": F.when(next_role == "assistant", next_text)})
    return rows.where("role = 'user' and answer is not null").select("conv_id", "turn", F.col("text").alias("question"), "answer")


#: What judging models are told (own wording).
JUDGE_SYSTEM = 'You check an answer against the sources it cites. Reply with one JSON object: {"verdict": "supported" | "partially_supported" | "unsupported", "unsupported_claims": [...], "reason": "..."}.'
CLAIM_SYSTEM = 'You check one claim against the sources it cites. Reply with one JSON object: {"label": "supported" | "unsupported" | "contradicted" | "not a claim", "reason": "..."}.'


def cited_block(sources: Column, cited: Column) -> Column:
    """The cited sources under their own numbers; ``sources`` is an array of ``struct<path, start_line, end_line, text>``."""
    one = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), location(F.element_at(sources, n)["path"], F.element_at(sources, n)["start_line"], F.element_at(sources, n)["end_line"]), F.lit("\n"), F.element_at(sources, n)["text"])
    return F.array_join(F.transform(F.array_sort(F.array_distinct(cited)), one), "\n\n")


def judge_message(question: Column, answer: Column, block: Column) -> Column:
    """What a judge of whole answers reads; null, and so no call, where nothing is cited."""
    return F.when(F.length(block) > 0, F.concat(F.lit("<sources>\n"), block, F.lit("\n</sources>\n\nQuestion: "), F.trim(question), F.lit("\n\nAnswer: "), F.trim(answer)))


def claim_message(claim: Column, block: Column) -> Column:
    return F.when(F.length(block) > 0, F.concat(F.lit("<sources>\n"), block, F.lit("\n</sources>\n\nClaim: "), F.trim(claim)))


def judge_answers(answers: DataFrame, provider: Provider, keep: Sequence[str], consent: bool = False) -> DataFrame:
    """``(*keep, verdict, claims, reason, error)`` of answers ``(question, reply, sources, cited)`` by a judging model.

    Only cited sources are shown; without any there is no verdict and the reason says so; a reply that was cut off is an error.
    """
    from quillon.functions.replies import verdict

    asked = answers.withColumn("message", judge_message(F.col("question"), F.col("reply"), cited_block(F.col("sources"), F.col("cited"))))
    got = complete(asked, provider, keep, JUDGE_SYSTEM, consent=consent).withColumn("v", verdict(F.col("reply")))
    none, cut = F.col("finish") == "no_context", F.col("finish") != "stop"
    return got.select(
        *keep, F.when(~cut, F.col("v.verdict")).alias("verdict"), F.when(~cut, F.col("v.claims")).alias("claims"), F.when(none, "nothing is cited").otherwise(F.col("v.reason")).alias("reason"),
        F.when(none, None).when(F.col("error").isNotNull(), F.col("error")).when(cut, F.concat(F.lit("the reply ended with "), "finish")).otherwise(F.col("v.error")).alias("error"),
    )


def judge_claims(claims: DataFrame, provider: Provider, keep: Sequence[str], consent: bool = False) -> DataFrame:
    """``(*keep, label, by, reason, error)`` of claims ``(text, cites, sources, cited)``: by rule without citations, else by a model."""
    from quillon.functions.replies import label

    ruled = judge_by_rule(claims).withColumn("message", F.when(F.col("by").isNull(), claim_message(F.col("text"), cited_block(F.col("sources"), F.col("cited")))))
    got = complete(ruled, provider, [*keep, "label", "by"], CLAIM_SYSTEM, consent=consent).withColumn("v", label(F.col("reply")))
    rule = F.col("by") == "rule"
    return got.select(
        *keep, F.when(rule, F.col("label")).otherwise(F.col("v.label")).alias("label"), F.coalesce("by", F.lit("judge")).alias("by"), F.when(rule, None).otherwise(F.col("v.reason")).alias("reason"),
        F.when(rule, None).otherwise(F.coalesce("error", "v.error")).alias("error"),
    )
