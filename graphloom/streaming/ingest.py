"""Ingestion as Structured Streaming: messages, run states, sessions, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import upsert

MESSAGE = "index_run_id string, project_id string, source_id string, source_type string, trigger string"
# Triggers, end states, session limits.
TRIGGERS = ("manual", "webhook", "schedule")
END_STATES = ("completed", "failed", "cancelled")
SESSION_MINUTES, QUERIES_KEPT, FOCUS_KEPT, RECAP_TOKENS = 30, 20, 10, 500


def messages(spark: SparkSession, path: str) -> DataFrame:
    """The stream of JSON lines that land below ``path``: value, and the parsed message, null if it is none."""
    raw = spark.readStream.format("text").load(path)
    return parse_messages(raw)


def parse_messages(raw: DataFrame) -> DataFrame:
    m = F.from_json("value", MESSAGE)
    whole = m["index_run_id"].isNotNull() & m["project_id"].isNotNull() & m["trigger"].isin(*TRIGGERS)
    return raw.select("value", F.when(whole, m).alias("message"))


def enqueue(messages_: DataFrame, path: str) -> None:
    """Append messages (the columns of ``MESSAGE``) to the landing folder."""
    messages_.select(F.to_json(F.struct(*messages_.columns)).alias("value")).write.mode("append").text(path)


def run_ingest(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str | None = None):
    """Hand each batch's whole messages to ``process`` and put the others aside.

    Offsets are committed after the batch, so it may come again after a failure: ``process`` must be an upsert. With
    ``availableNow`` the query ends when everything that has landed is done.
    """

    def batch(df: DataFrame, number: int) -> None:
        if dead_letters:
            df.where("message is null").select("value").write.mode("append").text(f"{dead_letters}/batch={number}")
        process(df.where("message is not null").select("message.*"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_states(transitions: DataFrame) -> DataFrame:
    """run_id, status, started_at, completed_at from (run_id, status, ts, seq): the last status; the first start; the end, if it is an end state."""
    order = F.struct("ts", "seq")
    by = transitions.groupBy("run_id").agg(F.max_by("status", order).alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("last"))
    return by.select("run_id", "status", "started_at", F.when(F.col("status").isin(*END_STATES), F.col("last")).alias("completed_at"))


def apply_transition(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """``runs`` (run_id, status, started_at, completed_at, error) after (run_id, status, ts, error) changes, one for each run."""
    now = changes.select("run_id", F.col("status").alias("to"), "ts", F.col("error").alias("e"))
    j = runs.join(now, "run_id", "inner")
    started = F.when(F.col("to") == "running", F.coalesce("started_at", "ts")).otherwise(F.col("started_at"))
    done = F.when(F.col("to").isin(*END_STATES), F.col("ts")).otherwise(F.col("completed_at"))
    new = j.select("run_id", F.col("to").alias("status"), started.alias("started_at"), done.alias("completed_at"), F.coalesce("e", "error").alias("error"))
    return upsert(runs, new, ["run_id"])


def sessions(events: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """user_id, started_at, ended_at, n of sessions that end after ``minutes`` without an event."""
    w = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event time; on a stream rows later than ``late`` are left out and finished windows leave the state."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_state(stream: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """user_id, n_seen, last_queries from a stream of (user_id, ts, symbol, query): session state that expires when it rests.

    The state of a user is the set of symbols seen and the last queries; it is dropped ``minutes`` after the last event by
    event time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, queries = state.get if state.exists else ([], [])
        seen, queries, last = list(seen), list(queries), None
        for frame in frames:
            for row in frame.sort_values("ts").itertuples():
                if row.symbol is not None and row.symbol not in seen:
                    seen.append(row.symbol)
                if row.query:
                    queries = [*queries, row.query][-QUERIES_KEPT:]
                last = row.ts if last is None or row.ts > last else last
        state.update((seen, queries))
        if last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame({"user_id": [key[0]], "n_seen": [len(seen)], "last_queries": [queries]})

    return stream.withWatermark("ts", "1 minute").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n_seen long, last_queries array<string>", "seen array<string>, queries array<string>", "update", GroupStateTimeout.EventTimeTimeout
    )


def trimmed_recap(entries: list[str], tokens: int = RECAP_TOKENS) -> list[str]:
    """The newest entries whose tokens (bytes / 4) sum to at most ``tokens``, at least one."""
    out: list[str] = []
    total = 0
    for e in reversed(entries):
        total += len(e.encode()) // 4
        if out and total > tokens:
            break
        out.append(e)
    return out[::-1]
