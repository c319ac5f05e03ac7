"""Streaming front-ends: an index kept up to date by micro-batches, windowed counts, and conversations as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.chunking import structured_chunks, with_ids
from quillon.operators.indexing import manifest_diff, manifest_of
from quillon.sources.tables import Merge, VersionedTables
from quillon.session import stored


FILE = ["repo_id", "path"]


def apply_batch(tables: VersionedTables, files: DataFrame) -> dict[str, int]:
    """Bring an index up to date with files that came in: ``repo_id, path, language, text, file_hash``; a null text removes a file.

    A file is known by repository and path.  Of several rows of a file in one batch the one with the greatest ``seq`` counts, if
    there is such a column; without it a batch has no order and a row with text counts before a removal.  Only files whose hash
    differs are chunked, a file's stale chunks go with it, and only the parts of the tables that hold such files are written anew,
    all in one commit.  Returns how many files were new, changed, unchanged and removed.  Doing a batch again changes nothing.
    """
    at = F.struct(F.col("seq") if "seq" in files.columns else F.lit(0).alias("seq"), F.col("text").isNotNull().alias("live"), "file_hash")
    latest = stored(files.groupBy(*FILE).agg(F.max_by(F.struct("language", "text", "file_hash"), at).alias("f")).select(*FILE, "f.*"))
    known = tables.read("manifest") if tables.is_built() else None
    mine = known.join(latest.select(*FILE), FILE, "left_semi") if known is not None else latest.select(*FILE, "file_hash").limit(0)
    live = latest.where("text is not null")
    diff = stored(manifest_diff(mine, live, FILE))
    todo = live.join(diff.where("status in ('new', 'changed')").select(*FILE), FILE, "left_semi")
    chunks = stored(with_ids(structured_chunks(todo)))
    gone = diff.where("status in ('changed', 'removed')").select(*FILE)
    counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if known is None or any(n for status, n in counts.items() if status != "unchanged"):
        tables.commit({"chunks": Merge(chunks, FILE, gone), "manifest": Merge(manifest_of(todo, chunks, FILE), FILE, gone)})
    return counts


def index_stream(files: DataFrame, tables: VersionedTables, checkpoint: str):
    """A query that applies each micro-batch of a stream of files to an index, exactly once per batch."""
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: apply_batch(tables, batch)).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, key, events, value)`` per tumbling window; on a stream, rows later than ``late`` are left out."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.window(time, width), key).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), key, "events", "value")


def conversation_state(turns: DataFrame, keep: int = 3, forget: str | None = "30 days") -> DataFrame:
    """A stream of answered turns as a stream of ``(conv_id, turns, history)``, the last ``keep`` questions of each conversation.

    A conversation without a turn for ``forget`` is forgotten, so the state holds live ones only.  Waiting for that keeps a query
    alive: one that is to end with its input (``availableNow``) takes ``None`` and forgets nothing.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    number, unit = (forget or "0 days").split()
    milliseconds = int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, questions = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("turn")
        answered = rows[rows["answer"].notna()]
        count, questions = count + len(answered), [*questions, *answered["question"].tolist()][-keep:]
        state.update((count, questions))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([(key[0], count, questions)], columns=["conv_id", "turns", "history"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.groupBy("conv_id").applyInPandasWithState(update, f"conv_id {kind}, turns long, history array<string>", "turns long, history array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout)
