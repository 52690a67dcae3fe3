"""Sessions that expire and have a quota: what each may add and fetch, decided alike over a table and over a stream.

events: session, at (seconds), id, kind, token, bytes. A session begins with `open`; `touch` and `fetch` keep it alive, `add` registers a file under a token, and
`fetch` may have only what the same session added. A session that nothing has kept alive for longer than its time to live is gone, with its files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dealing import in_sequence
from .buckets import MAX_BYTES, MAX_FILES, SESSION_SECONDS, fits

EVENT = "at double, id long, kind string, token string, bytes long"
FIELDS = ("at", "id", "kind", "token", "bytes")
DECISION = f"session string, {EVENT}, accepted boolean, files int, used long"
#: What the state store of streams needs: transformWithState keeps its columns there.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass
class Limits:
    ttl: float = SESSION_SECONDS
    max_files: int = MAX_FILES
    max_bytes: int = MAX_BYTES


@dataclass
class Session:
    """What is kept of a live session. Its tokens are as many as its files at most, which are bounded."""

    seen: float
    files: int = 0
    used: int = 0
    tokens: set[str] = field(default_factory=set)


def decide(state: Session | None, event: dict, limits: Limits) -> tuple[Session | None, tuple[bool, int, int]]:
    """The session after an event, and whether the event is accepted with the files and bytes that the session then has. Unknown kinds are refused."""
    at, kind = event["at"], event["kind"]
    if state and at - state.seen > limits.ttl:
        state = None
    accepted = False
    if kind == "open":
        state, accepted = Session(at), True
    elif state and kind == "touch":
        state.seen, accepted = at, True
    elif state and kind == "fetch":
        state.seen, accepted = at, event["token"] in state.tokens
    elif state and kind == "add":
        size = event["bytes"] or 0
        accepted = fits(state.files, state.used, size, limits.max_files, limits.max_bytes)
        if accepted:  # what is refused takes no room
            state.files, state.used = state.files + 1, state.used + size
            state.tokens.add(event["token"])
    return state, (accepted, state.files if state else 0, state.used if state else 0)


def _events(df: DataFrame) -> DataFrame:
    kinds = T.StructType.fromDDL("session string, " + EVENT)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).where("session is not null and at is not null")


def decisions(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """DECISION for each event, in order of time and id within a session. Events without a session or a time have none."""
    return in_sequence(_events(events), ["session"], ["at", "id"], lambda state, row: decide(state, row, limits), "accepted boolean, files int, used long")


class _Keyed(StatefulProcessor):
    """A session's state in a stream: a value (when seen, files, bytes), a map (its tokens), and the events that the watermark hasn't passed yet.

    Events wait until the watermark passes them, so they are decided in order of time however they arrive. A timer at each event's time decides it, and one at the
    end of the session's time to live forgets the session."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "seen double, files int, used long")
        self.tokens = handle.getMapState("tokens", "token string", "at double")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            events = [(r.at, int(r.id), r.kind, r.token, None if pd.isna(r.bytes) else int(r.bytes)) for r in frame.itertuples()]
            self.waiting.appendList(events)
            for due in {_millis(e[0]) for e in events}:
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.waiting.get())
        now = sorted((e for e in waiting if _millis(e[0]) <= due), key=lambda e: (e[0], e[1]))
        state = None
        if self.session.exists():
            seen, files, used = self.session.get()
            state = Session(seen, files, used, {k[0] for k in self.tokens.keys()})
        out = []
        for e in now:
            state, decided = decide(state, dict(zip(FIELDS, e)), self.limits)
            out.append((key[0], *e, *decided))
        if state and not now and due - _millis(state.seen + self.limits.ttl) > 0:
            state = None
        if now:
            if left := [e for e in waiting if _millis(e[0]) > due]:
                self.waiting.put([tuple(e) for e in left])
            else:
                self.waiting.clear()
        self._keep(state)
        if out:
            yield pd.DataFrame(out, columns=["session", *FIELDS, "accepted", "files", "used"]).astype({"bytes": "Int64"})

    def _keep(self, state: Session | None) -> None:
        if state is None:
            self.session.clear()
            self.tokens.clear()
            return
        self.session.update((state.seen, state.files, state.used))
        known = {k[0] for k in self.tokens.keys()}
        for gone in known - state.tokens:  # of a session that was opened anew
            self.tokens.removeKey((gone,))
        for token in state.tokens - known:
            self.tokens.updateValue((token,), (state.seen,))
        self.handle.registerTimer(_millis(state.seen + self.limits.ttl) + 1)

    def close(self) -> None:
        pass


def _millis(at: float) -> int:
    return int(at * 1000) + 1


def decisions_stream(events: DataFrame, limits: Limits = Limits(), late: str = "10 minutes") -> DataFrame:
    """The same over a stream, behind a watermark: an event is decided when nothing earlier can come any more, so the rows are those of the table however events
    arrive. Events later than `late` behind the newest are dropped. The session needs STATE_STORE."""
    own = _events(events).withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long") + 1)).withWatermark("ts", late)
    return own.groupBy("session").transformWithStateInPandas(statefulProcessor=_Keyed(limits), outputStructType=DECISION, outputMode="append", timeMode="EventTime")
