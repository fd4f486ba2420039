"""Streams: feedback events to reflections and memories; session items as keyed state are in mnemos.streaming.sessions.

The batch operators do the work; a stream adds the source, the checkpoint and batch ids that make a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mnemos.config import DEFAULT, EngineConfig
from mnemos.operators import changes, feedback
from mnemos.operators.graph import new_id
from mnemos.operators.ingest import embedded
from mnemos.schemas import FEEDBACK_EVENTS, conform
from mnemos.sources.store import SnapshotStore, Transaction
from mnemos.streaming.sessions import SESSION_EVENT, session_stream  # noqa: F401


def apply_feedback(store: SnapshotStore, events: DataFrame, now: datetime, config: EngineConfig = DEFAULT, batch: str | None = None, pending: bool = False, keep_failed: bool = False) -> DataFrame:
    """Apply a batch of feedback to a store in one commit; returns the invalid events.

    pending: events and weights are written, reflections are left for process_pending(). keep_failed: invalid events go to
    the table feedback_failed, with what is wrong and the event as JSON, in the same commit.
    """
    at = F.lit(now).cast("timestamp")
    checked = feedback.validated(conform(events, "feedback_events"))

    def work(own: Transaction) -> None:
        known, memories = own.read("feedback_events"), own.read("memories")
        valid = checked.where("problem IS NULL").drop("problem").dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
        deltas = feedback.weight_deltas(valid, config)
        named = memories.join(deltas.select("id").distinct(), "id", "left_semi")
        own.upsert("feedback_events", valid)
        if keep_failed:
            event = F.to_json(F.struct(*[c for c in checked.columns if c != "problem"]), {"ignoreNullFields": "false"})
            failed = checked.where("problem IS NOT NULL").select(F.coalesce("id", new_id("lost_", event)).alias("id"), "problem", event.alias("event"), at.alias("created_at"))
            own.upsert("feedback_failed", failed)
        own.upsert("memories", changes.adjust_weights(named, deltas))
        if pending:
            own.upsert("reflection_records", feedback.pending_rows(valid, at))
        else:
            _finish(own, valid, memories, at, config)

    store.transact(work, batch)
    return checked.where("problem IS NOT NULL")


def _finish(own: Transaction, events: DataFrame, memories: DataFrame, at, config: EngineConfig) -> None:
    """Put the events' reflections, and the memories and vectors that follow from them, into a transaction."""
    final = feedback.finalise(feedback.drafts(feedback.with_related(events, memories)), config)
    rows = conform(feedback.derived_memories(final, at), "memories")
    own.upsert("memories", rows)
    own.upsert("embeddings", embedded(rows, at, config))
    own.upsert("reflection_records", feedback.reflection_rows(final, at))


def process_pending(store: SnapshotStore, now: datetime, config: EngineConfig = DEFAULT, batch: str | None = None) -> None:
    """Finish all pending reflections."""

    def work(own: Transaction) -> None:
        waiting = own.read("reflection_records").where("status = 'pending'").select(F.col("feedback_id").alias("id"))
        events = own.read("feedback_events").join(waiting, "id", "left_semi")
        _finish(own, events, own.read("memories"), F.lit(now).cast("timestamp"), config)

    store.transact(work, batch)


def feedback_stream(spark: SparkSession, source: str, store: SnapshotStore, checkpoint: str, now: datetime | Callable[[], datetime], config: EngineConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """A query that applies JSON files of feedback events as they arrive, each batch at the time that `now` gives then.

    A batch that was committed is skipped when it comes again, one that wasn't has left nothing: its parts are named by no
    version. Events that can't be applied stop nothing; they are in the table feedback_failed.
    """

    def apply(events: DataFrame, number: int) -> None:
        apply_feedback(store, events, now() if callable(now) else now, config, batch=f"feedback-{number}", keep_failed=True)

    stream = spark.readStream.schema(FEEDBACK_EVENTS).json(source)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def nightly(config: EngineConfig = DEFAULT) -> str | None:
    """The cron line of the nightly consolidation for an outside scheduler, or None if it is off."""
    return f"{config.scheduler_minute} {config.scheduler_hour} * * *" if config.scheduler_enabled else None
