"""Rate limits and sessions per key, in batch and in streams. Time is event time, so a rerun decides alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dealing import in_sequence

RATE, PER, BURST, IDLE_SECONDS = 12.0, 300.0, 4.0, 3600
SESSION_SECONDS, MAX_FILES, MAX_BYTES = 1800, 40, 250 << 20
DECISION = "key string, at double, id long, admitted boolean, wait double"


def admit(tokens: float, last: float | None, at: float, rate: float, per: float, burst: float) -> tuple[bool, float, float]:
    """Whether a request at `at` is admitted, the seconds to wait if not, and the tokens left."""
    tokens = burst if last is None else min(burst, tokens + (at - last) * (rate / per))
    return (True, 0.0, tokens - 1.0) if tokens >= 1.0 else (False, (1.0 - tokens) * (per / rate), tokens)


def _decide(key: str, rows: pd.DataFrame, tokens: float, last: float | None, rate: float, per: float, burst: float) -> tuple[pd.DataFrame, float, float | None]:
    out = []
    for at, ident in zip(*(rows.sort_values(["at", "id"])[c] for c in ("at", "id"))):
        if last is not None and at - last > IDLE_SECONDS:
            last = None  # a bucket idle for so long is full
        ok, wait, tokens = admit(tokens, last, at, rate, per, burst)
        last = at
        out.append((key, at, ident, ok, wait))
    return pd.DataFrame(out, columns=["key", "at", "id", "admitted", "wait"]), tokens, last


def token_bucket(requests: DataFrame, rate: float = RATE, per: float = PER, burst: float = BURST) -> DataFrame:
    """requests: key, at (seconds), id. One decision each, in order of time and id within a key."""

    def step(state: tuple[float, float] | None, row: dict) -> tuple[tuple[float, float], tuple[bool, float]]:
        tokens, last = state if state and row["at"] - state[1] <= IDLE_SECONDS else (0.0, None)
        ok, wait, tokens = admit(tokens, last, row["at"], rate, per, burst)
        return (tokens, row["at"]), (ok, wait)

    own = requests.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"))
    return in_sequence(own, ["key"], ["at", "id"], step, "admitted boolean, wait double")


def token_bucket_stream(requests: DataFrame, rate: float = RATE, per: float = PER, burst: float = BURST, late: str = "1 hour") -> DataFrame:
    """The same over a stream, with a bucket's tokens and last time as its state. A request that is later than `late` behind the newest is dropped; the state of a key that is idle by then goes."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (0.0, None)
        out, tokens, last = _decide(key[0], pd.concat(list(frames)), tokens, last, rate, per, burst)
        state.update((tokens, last))
        state.setTimeoutTimestamp(int((last + IDLE_SECONDS) * 1000) + 1)
        yield out

    own = requests.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.col("id").cast("long").alias("id"))
    own = own.withColumn("ts", F.timestamp_seconds(F.col("at") + 1)).withWatermark("ts", late)  # a stream's first watermark is at 0, and what is not after it is late
    return own.groupBy("key").applyInPandasWithState(run, DECISION, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, ts: str, ttl: int = SESSION_SECONDS) -> DataFrame:
    """events with session, from 0 per key: a new one where more than ttl seconds have passed since the last event."""
    order = W.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    gap = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order)) > ttl * 1_000_000
    marked = events.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    return marked.withColumn("session", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def session_windows(events: DataFrame, key: str, ts: str, ttl: int = SESSION_SECONDS) -> DataFrame:
    """Sessions as windows with counts, for batch and, behind a watermark, for streams."""
    return events.groupBy(key, F.session_window(ts, f"{ttl} seconds").alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def quota(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files: session, seq, bytes. accepted: whether the session has room for the file, in order of seq; one that is refused takes no room, so a smaller one may follow. Null bytes are 0."""

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple[bool]]:
        n, used = state or (0, 0)
        size = row["bytes"] or 0
        return ((n + 1, used + size), (True,)) if fits(n, used, size, max_files, max_bytes) else ((n, used), (False,))

    return in_sequence(files, ["session"], ["seq"], step, "accepted boolean")


def fits(n: int, used: int, size: int, max_files: int, max_bytes: int) -> bool:
    return n < max_files and used + size <= max_bytes


def failure_windows(failures: DataFrame, every: str = "1 day") -> DataFrame:
    """Failures per window and endpoint; over a stream behind a watermark on at_ts."""
    return failures.groupBy(F.window("at_ts", every).alias("w"), "endpoint").agg(F.count("*").alias("failures")).select(F.col("w.start").alias("start"), "endpoint", "failures")
