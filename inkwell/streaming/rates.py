"""Sliding request and token rates, admission control, traces and incremental deduplication, on streams and on tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, MINUTE = 3600, 60


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _sliding(events: DataFrame, keys: tuple[str, ...], ts: str, seconds: int, name: str, value: Column) -> DataFrame:
    """Adds `name`, `value` aggregated over the last `seconds` up to each row, itself and ties included, one exactly `seconds` old excluded.

    Time is cut into spans of `seconds`, and every row also goes with the span after its own, which sees no further back: however many rows a key
    has, or all of them without a key, a group is two spans of it.
    """
    t, span = _seconds(ts), seconds * 1_000_000
    own = F.when(t.isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    rows = events.withColumn("_t", t).withColumn("_own", F.explode(own)).withColumn("_span", F.floor(F.col("_t") / span) + F.when(F.col("_own"), 0).otherwise(1))
    window = Window.partitionBy(*keys, "_span").orderBy("_t").rangeBetween(-(span - 1), 0)
    return rows.withColumn(name, value.over(window)).where("_own").drop("_t", "_own", "_span")


def arrival_rate(events: DataFrame, key: str, ts: str, seconds: int = HOUR) -> DataFrame:
    """Adds `recent`: events of the key in the last `seconds` up to this one, itself and ties included, one exactly `seconds` old excluded."""
    return _sliding(events, (key,), ts, seconds, "recent", F.count(F.lit(1)))


def token_rate(events: DataFrame, tokens: str, ts: str, seconds: int = MINUTE, limit: int = 250_000, share: float = 0.9, *keys: str) -> DataFrame:
    """Adds `used`, the tokens of the last `seconds` with this request, and `wait`, the seconds to wait before it: over / limit * 60, else 0.

    Give the keys whose budgets are separate; without any the whole stream is one budget.
    """
    over = F.col("used") - limit * share
    return _sliding(events, keys, ts, seconds, "used", F.sum(tokens)).withColumn("wait", F.when(over > 0, over / limit * seconds).otherwise(0.0))


def too_large(tokens, request_limit: int = 200_000, minute_limit: int = 250_000, share: float = 0.95):
    """A request that no waiting makes fit."""
    return F.col(tokens) > min(request_limit, minute_limit) * share


def admit(times: list[float], limit: int, seconds: int, held: list[float]) -> tuple[list[bool], list[float]]:
    """Which of the ordered requests are let in, given the times already let in: fewer than `limit` in the last `seconds`. A refused one is not recorded."""
    from collections import deque

    recent, out = deque(held), []
    for t in times:
        while recent and recent[0] <= t - seconds:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, list(recent)


def admission(events: DataFrame, key: str, ts: str, event: str, limit: int, seconds: int = HOUR) -> DataFrame:
    """(event, key, admitted) of a table. Ties go by event id; events without a time or key are left out.

    Rows arrive sorted by key and time and pass by as a stream: a key with a third of all events costs the memory of `limit` times, not of its events.
    """
    rows = events.select(F.col(event).alias("event"), F.col(key).alias("key"), (_seconds(ts) / 1e6).alias("t")).where("t IS NOT NULL AND key IS NOT NULL")
    schema = f"{event} {events.schema[event].dataType.simpleString()}, {key} {events.schema[key].dataType.simpleString()}, admitted boolean"

    def fold(frames):
        last, held = None, []
        for pdf in frames:
            out = []
            for k, times in pdf.groupby("key", sort=False)["t"]:
                flags, held = admit(times.tolist(), limit, seconds, held if k == last else [])
                last = k
                out += flags
            yield pd.DataFrame({event: pdf["event"], key: pdf["key"], "admitted": out})

    return rows.repartition("key").sortWithinPartitions("key", "t", "event").mapInPandas(fold, schema)


def admission_stream(events: DataFrame, key: str, ts: str, event: str, limit: int, seconds: int = HOUR) -> DataFrame:
    """(event, key, admitted) of a stream; the state of a key is the times it was let in, at most `limit`, dropped after `seconds` of silence."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = {c: events.schema[c].dataType.simpleString() for c in (event, key)}
    rows = events.select(F.col(event).alias("event"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes")

    def step(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event"])
        held = list(state.get[0]) if state.exists else []
        admitted, held = admit([t.timestamp() for t in pdf["ts"]], limit, seconds, held)
        state.update((held,))
        state.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds * 1000)
        yield pd.DataFrame({event: pdf["event"], key: keys[0], "admitted": admitted})

    return rows.groupBy("key").applyInPandasWithState(step, f"{event} {kinds[event]}, {key} {kinds[key]}, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def hourly(events: DataFrame, key: str, ts: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """(key, start, n): events per key and hour, on a stream with a watermark; a stream and a table of the same events give the same rows."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.col(key), F.window("_t", every)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events of a key no further apart than the gap."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.col(key), F.session_window("_t", gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(texts: DataFrame, ts: str, text: str = "text", late: str = "1 day") -> DataFrame:
    """Each text once, by hash, within the watermark: the incremental form of the anti-join on a cache."""
    timed = texts.withColumn("chunk_hash", F.md5(text)).withColumn("_t", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_t", late).dropDuplicatesWithinWatermark(["chunk_hash"]).drop("_t") if texts.isStreaming else timed.drop("_t").dropDuplicates(["chunk_hash"])


def traces(events: DataFrame, ts: str, key: str, n: int = 200) -> DataFrame:
    """The last n events, 1 to 200 of them, newest first."""
    return events.orderBy(F.desc(ts), F.desc(key)).limit(max(1, min(200, n)))


def job_states(polls: DataFrame) -> DataFrame:
    """(job_id, status, polled_at, polls): the furthest state of each job and its last poll; complete and error outrank processing, and that pending."""
    rank = F.when(F.col("status").isin("complete", "error"), 2).when(F.col("status") == "processing", 1).otherwise(0)
    best = F.max(F.struct(rank.alias("r"), F.col("polled_at"), F.col("status")))
    return polls.where("job_id IS NOT NULL").groupBy("job_id").agg(best.alias("b"), F.count(F.lit(1)).alias("polls")).select("job_id", "b.status", "b.polled_at", "polls")
