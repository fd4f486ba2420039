"""Feedback: validation, weights, reflection drafts and their way to derived memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import vocabulary as V
from mnemos.functions.text import cut, strip
from mnemos.functions.vector import small
from mnemos.operators.graph import new_id

TYPES = ("upvote", "downvote", "correct")
EDGES = " ，,。"


def validated(events: DataFrame) -> DataFrame:
    """events with a trimmed lower-case feedback_type and `problem`: null, or what is wrong."""
    kind = strip(F.lower("feedback_type"))
    blank = ~F.coalesce("correction_text", F.lit("")).rlike(r"(?U)\S")
    problem = F.when(kind.isNull() | ~kind.isin(*TYPES), "unknown feedback type").when((kind == "correct") & blank, "correction text is missing")
    return events.withColumn("problem", problem).withColumn("feedback_type", kind)


def weight_deltas(events: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """id, seq and delta of every memory that valid events name; repeated names count repeatedly."""
    amount = F.when(F.col("feedback_type") == "upvote", config.upvote_delta).otherwise(config.downvote_delta)
    named = events.select(F.struct("created_at", "id").alias("when"), amount.alias("delta"), F.posexplode("related_memory_ids").alias("pos", "memory_id"))
    return named.select(F.col("memory_id").alias("id"), F.struct("when", "pos").alias("seq"), "delta")


def normal_correction(text: Column) -> Column:
    """`X not Y` as a sentence about the right and the wrong; else a full stop is added where an end is missing."""
    t = strip(text)
    part = lambda i: F.regexp_replace(F.regexp_replace(F.regexp_extract(t, f"(?U){V.CORRECTION}", i), f"^[{EDGES}]+", ""), f"[{EDGES}]+$", "")
    a, b, c = V.CORRECTION_TEXT
    ended = t.rlike("[。.！!]$")
    return F.when(t.rlike(f"(?U){V.CORRECTION}"), F.concat(F.lit(a), part(1), F.lit(b), part(2), F.lit(c))).when((t != "") & ~ended, F.concat(t, F.lit("。"))).otherwise(t)


def drafts(events: DataFrame) -> DataFrame:
    """events (feedback_type, correction_text, answer_text, related: array of contents) with `draft`: analysis, summary,

    confidence, memory_type and pinned.
    """
    text = strip(F.coalesce("correction_text", F.lit("")))
    answer, related = F.coalesce("answer_text", F.lit("")), F.coalesce("related", F.array().cast("array<string>"))
    identity = text.rlike(f"(?iU){V.IDENTITY_MARKS}")
    sure = F.when(F.length(text) >= 6, 0.9).otherwise(0.75)
    a, b, c, d = V.CORRECTED
    parts = F.array_compact(F.array(F.lit(a), F.concat(F.lit(b), text), F.when(answer != "", F.concat(F.lit(c), cut(answer, 200))), F.when(F.size(related) > 0, F.concat(F.lit(d), F.size(related).cast("string")))))
    made = lambda analysis, summary, confidence, kind, pinned: F.struct(analysis.alias("analysis"), summary.alias("summary"), confidence.cast("double").alias("confidence"), kind.alias("memory_type"), pinned.alias("pinned"))
    short = made(F.lit(V.TOO_SHORT), F.lit(""), F.lit(0.2), F.lit("reflection"), F.lit(False))
    right = made(F.array_join(parts, " "), normal_correction(text), F.when(identity, F.greatest(sure, F.lit(0.92))).otherwise(sure), F.when(identity, "identity").otherwise("fact"), identity)
    joined = F.array_join(F.transform(F.slice(related, 1, 3), lambda x: F.substring(x, 1, 80)), V.FRAGMENT_JOIN)
    summary = F.when(text != "", F.concat(F.lit(V.DOWNVOTED[0]), text)).when(F.size(related) > 0, F.concat(F.lit(V.DOWNVOTED[1]), joined)).when(answer != "", F.concat(F.lit(V.DOWNVOTED[2]), cut(answer, 160))).otherwise(F.lit(V.DOWNVOTED[3]))
    trust = F.when(text != "", 0.8).when(F.size(related) > 0, 0.72).when(answer != "", 0.7).otherwise(0.45)
    wrong = made(F.lit(V.DOWNVOTE_ANALYSIS), summary, trust, F.lit("negative"), F.lit(False))
    none = made(F.lit("upvote does not require reflection"), F.lit(""), F.lit(0.0), F.lit("reflection"), F.lit(False))
    kind = F.col("feedback_type")
    return events.withColumn("draft", F.when((kind == "correct") & (F.length(text) < 2), short).when(kind == "correct", right).when(kind == "downvote", wrong).otherwise(none))


def with_related(events: DataFrame, memories: DataFrame) -> DataFrame:
    """events with `related`: contents of the active memories that they name, in the order of the names."""
    named = events.select("id", F.posexplode("related_memory_ids").alias("pos", "memory_id"))
    rows = memories.where("deleted_at IS NULL").select(F.col("id").alias("memory_id"), "content").join(small(named), "memory_id")
    lists = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("related"))
    return events.join(lists, "id", "left")


def finalise(events: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Reflection status of drafted events that aren't upvotes, and whether and how a memory is derived from them."""
    d = F.col("draft")
    low = (d["confidence"] < config.reflection_threshold) | ~d["summary"].rlike(r"(?U)\S")
    writes = ~low & ((F.col("feedback_type") == "correct") | F.lit(config.downvote_writes_negative))
    pinned = F.when((F.col("feedback_type") == "correct") & (d["memory_type"] == "identity"), True).when(F.col("feedback_type") == "correct", F.lit(config.correct_creates_pinned)).otherwise(False)
    out = events.where("feedback_type <> 'upvote'").withColumn("status", F.when(low, "rejected_low_confidence").otherwise("accepted"))
    return out.withColumn("writes", writes).withColumn("derived_memory_id", F.when(writes, new_id("mem_", F.col("id")))).withColumn("derived_pinned", pinned).withColumn("derived_importance", F.greatest(F.lit(0.85), d["confidence"]))


def derived_memories(final: DataFrame, now: Column) -> DataFrame:
    """The memories that accepted reflections write."""
    d = F.col("draft")
    return final.where("writes").select(
        F.col("derived_memory_id").alias("id"), "tenant_id", "user_id", "session_id", d["summary"].alias("content"), d["memory_type"].alias("memory_type"),
        F.when(F.col("derived_pinned"), F.greatest("derived_importance", F.lit(0.9))).otherwise(F.col("derived_importance")).alias("importance"), F.lit(1.0).alias("weight"), F.col("derived_pinned").alias("pinned"),
        F.lit("reflection").alias("source"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).alias("access_count"),
    )


def reflection_rows(final: DataFrame, now: Column) -> DataFrame:
    d = F.col("draft")
    return final.select(new_id("ref_", F.col("id")).alias("id"), F.col("id").alias("feedback_id"), d["analysis"].alias("analysis"), d["summary"].alias("summary"), d["confidence"].alias("confidence"), "derived_memory_id", "status", now.alias("created_at"))


def pending_rows(events: DataFrame, now: Column) -> DataFrame:
    """Reflections of events whose turn hasn't come."""
    none = F.lit(None).cast("string")
    return events.where("feedback_type <> 'upvote'").select(new_id("ref_", F.col("id")).alias("id"), F.col("id").alias("feedback_id"), none.alias("analysis"), none.alias("summary"), F.lit(0.0).alias("confidence"), none.alias("derived_memory_id"), F.lit("pending").alias("status"), now.alias("created_at"))


def with_reflection(events: DataFrame, reflections: DataFrame) -> DataFrame:
    """Every event and its first reflection, if any."""
    from mnemos.operators.lookup import first_by

    first = first_by(reflections.select(F.col("feedback_id").alias("id"), F.col("id").alias("reflection_id"), "status", "derived_memory_id", F.col("created_at").alias("reflected_at")), ["id"], [F.col("reflected_at"), F.col("reflection_id")])
    return events.join(first, "id", "left")
