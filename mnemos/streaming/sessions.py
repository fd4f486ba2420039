"""Session items as keyed state: a bounded list for each session, let out by a close event or by a timer in event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mnemos.config import DEFAULT, EngineConfig
from mnemos.operators.ingest import promotion

SESSION_EVENT = "session_id string, kind string, id string, content string, importance double, weight double, pinned boolean, created_at timestamp, seq long"
STATE = "id string, content string, importance double, weight double, pinned boolean, seq long, at long"
CLOSED = f"session_id string, {STATE}, closed_at long"
FIELDS = ["id", "content", "importance", "weight", "pinned", "seq", "at"]


class SessionItems(StatefulProcessor):
    """Keeps a session's `most` best items; times are microseconds, the timer is `timeout_ms` after the last event."""

    def __init__(self, most: int, timeout_ms: int):
        self.most, self.timeout_ms = most, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, ends, latest, closing = self._held(), [], [], False
        for pdf in rows:
            close = pdf["kind"] == "close"
            closing = closing or bool(close.any())
            ends.append(pdf.loc[close, "at"].max())
            latest.append(pdf["at"].max())
            held = self._best(pd.concat([held, pdf.loc[~close, FIELDS].astype(object)], ignore_index=True))
        timers = list(self.handle.listTimers())
        if closing:
            yield from self._out(key, held, ends, timers)
            return
        self.items.put([tuple(None if pd.isna(v) else v for v in row) for row in held.itertuples(index=False)])
        times = [int(at) // 1000 for at in latest if not pd.isna(at)] or ([] if timers else [timerValues.getCurrentWatermarkInMs()])
        due = max(timers + [at + self.timeout_ms for at in times])
        if due not in timers:
            self.handle.registerTimer(due)
        for old in timers:
            if old != due:
                self.handle.deleteTimer(old)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._out(key, self._held(), [due * 1000], [t for t in self.handle.listTimers() if t != due])

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(row) for row in self.items.get()], columns=FIELDS, dtype=object)

    def _best(self, items: pd.DataFrame) -> pd.DataFrame:
        """The best items: by weighted importance, newer first, then in order of arrival. Bests of bests are the whole's."""
        rank = pd.to_numeric(items["importance"]) * pd.to_numeric(items["weight"])
        ordered = items.assign(rank=rank, at=pd.to_numeric(items["at"])).sort_values(["rank", "at", "seq", "id"], ascending=[False, False, True, True])
        return ordered.drop(columns="rank").head(self.most)

    def _out(self, key: Any, held: pd.DataFrame, ends: list, timers: list[int]) -> Iterator[pd.DataFrame]:
        """Let a session's items out; where the closing event has no time, it is that of the newest item."""
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.items.clear()
        known = [at for at in ends if not pd.isna(at)] or [pd.to_numeric(held["at"]).max()]
        if len(held):
            yield held.assign(session_id=key[0], closed_at=max(known))[["session_id", *FIELDS, "closed_at"]].astype({"importance": float, "weight": float, "pinned": bool, "seq": "int64", "at": "Int64", "closed_at": "Int64"})


def session_stream(events: DataFrame, now: datetime | None = None, config: EngineConfig = DEFAULT, timeout_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """Items of sessions held as keyed state, at most l1_max_items each; a `close` event (or the timeout) lets them out.

    events: SESSION_EVENT, kind `item` or `close`. Out come the items of a closed session with closed_at, score and
    `promoted`, taken at closed_at: the time of the close event, or timeout_ms after the session's last event (`now`, if
    given, stands for it). A close takes its own batch's items along; later ones begin the session anew. Events that are
    later than `delay` behind the newest one are dropped, as are those without session_id. Needs the RocksDB state store,
    which mnemos.session sets.
    """
    told = events.where("session_id IS NOT NULL").withWatermark("created_at", delay)
    told = told.select("session_id", "kind", "id", "content", "importance", "weight", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.unix_micros("created_at").alias("at"), "created_at")
    processor = SessionItems(config.l1_max_items, timeout_ms)
    closed = told.groupBy("session_id").transformWithStateInPandas(processor, CLOSED, "append", "EventTime")
    closed = closed.withColumn("created_at", F.timestamp_micros("at")).withColumn("closed_at", F.timestamp_micros("closed_at"))
    at = F.col("closed_at") if now is None else F.lit(now).cast("timestamp")
    return promotion(closed, at, config).select("session_id", "id", "content", "promoted", "score", "closed_at")
