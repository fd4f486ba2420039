"""Remembering in batches: importance, session items, long-term rows; closing sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions.vector import hash_embed, small
from mnemos.operators.changes import evict
from mnemos.operators.graph import new_id


@dataclass
class IngestResult:
    """What a batch of rows becomes: each table's new rows, and rows that are kept nowhere."""

    rows: DataFrame
    l1_items: DataFrame
    memories: DataFrame
    embeddings: DataFrame
    rejects: DataFrame


def flagged(rows: DataFrame, now: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """rows (ord, content, user_id, tenant_id, session_id, memory_type, importance, pinned) with id, resolved importance and

    layer: L2 if pinned or important enough, else L1 in a session, else none. A column `seed`, if there is one, takes ord's
    place in ids.
    """
    for name, kind, default in (("tenant_id", "string", None), ("session_id", "string", None), ("memory_type", "string", "fact"), ("importance", "double", 0.5), ("pinned", "boolean", False)):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(kind)) if name in rows.columns else F.lit(default).cast(kind))
    out = rows.withColumn("importance", S.resolve_importance(F.col("content"), F.col("memory_type"), F.col("pinned"), F.col("importance"), config))
    keep = F.col("pinned") | (F.col("importance") >= config.promotion_threshold)
    layer = F.when(keep, "L2").when(F.col("session_id").isNotNull(), "L1").otherwise("none")
    return out.withColumn("id", new_id("mem_", F.col("seed" if "seed" in rows.columns else "ord"), F.col("user_id"), F.col("session_id"), F.col("content"))).withColumn("layer", layer).withColumn("created_at", now).withColumn("weight", F.lit(1.0))


def as_memories(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("id", "tenant_id", "user_id", "session_id", "content", "memory_type", "importance", "weight", "pinned", F.lit(source).alias("source"), F.lit("{}").alias("meta_json"), "created_at", F.col("created_at").alias("updated_at"), F.lit(0).alias("access_count"))


def embedded(memories: DataFrame, now: Column, config: EngineConfig = DEFAULT, embed=None) -> DataFrame:
    """Vector rows of memories; embed(df, id_col, text_col, dim) is the hashing embedder by default."""
    vectors = (embed or hash_embed)(memories.select("id", "content"), "id", "content", config.embedding_dim)
    return memories.select("id", "user_id").join(vectors, "id").select(F.col("id").alias("memory_id"), "user_id", F.lit(config.embedding_model).alias("model"), F.lit(config.embedding_dim).alias("dim"), "vector", now.alias("created_at"))


def remember(rows: DataFrame, l1_items: DataFrame, now: Column, config: EngineConfig = DEFAULT, embed=None) -> IngestResult:
    """A batch of rows in one pass; session caches keep their most important items."""
    made = flagged(rows, now, config)
    last = l1_items.groupBy("session_id").agg(F.max("seq").alias("last"))
    cached = made.where("session_id IS NOT NULL").join(small(last), "session_id", "left")
    items = cached.select("id", "session_id", (F.coalesce("last", F.lit(-1)) + 1 + F.col("ord")).cast("long").alias("seq"), "content", "memory_type", "importance", "weight", "pinned", "user_id", "tenant_id", "created_at")
    kept = evict(l1_items.unionByName(items, allowMissingColumns=True), config.l1_max_items).where("kept").drop("place", "kept")
    memories = as_memories(made.where("layer = 'L2'"), "ingest")
    return IngestResult(made, kept, memories, embedded(memories, now, config, embed), made.where("layer = 'none'").withColumn("reason", F.lit("not important enough and no session")))


def promotion(l1_items: DataFrame, now: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """Session items with `promoted`: pinned, or of a high enough effective score."""
    score = S.effective_score(F.col("importance"), F.col("weight"), F.col("created_at"), now, config.decay_lambda)
    return l1_items.withColumn("score", score).withColumn("promoted", F.col("pinned") | (F.col("score") >= config.promotion_threshold))


def close(sessions: DataFrame, ids: DataFrame, l1_items: DataFrame, memories: DataFrame, now: Column, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sessions, promoted memories, items left, report) after closing listed sessions.

    The report has a row for each listed id: closed with its counts, `not_found` or `conflict` (closed before). An item that
    is in long-term memory already isn't written again.
    """
    asked = ids.select("id").distinct().join(sessions.select("id", "status"), "id", "left")
    asked = asked.withColumn("outcome", F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "closed", "conflict").otherwise("closed"))
    closing = small(asked.where("outcome = 'closed'").select("id"))
    own = promotion(l1_items.join(closing.select(F.col("id").alias("session_id")), "session_id", "left_semi"), now, config)
    new = own.where("promoted").join(memories.select("id"), "id", "left_anti")
    counts = own.groupBy("session_id").agg(F.count_if("promoted").alias("promoted_count"), F.count_if(~F.col("promoted")).alias("dropped_count"))
    report = asked.join(counts.withColumnRenamed("session_id", "id"), "id", "left").select("id", "outcome", F.coalesce("promoted_count", F.lit(0)).alias("promoted_count"), F.coalesce("dropped_count", F.lit(0)).alias("dropped_count"))
    marked = sessions.join(closing.withColumn("closing", F.lit(True)), "id", "left")
    after = _closed(marked, now)
    left = l1_items.join(closing.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return after, as_memories(new, "promotion"), left, report


def _closed(marked: DataFrame, now: Column) -> DataFrame:
    hit = F.coalesce(F.col("closing"), F.lit(False))
    return marked.withColumn("status", F.when(hit, "closed").otherwise(F.col("status"))).withColumn("closed_at", F.when(hit, now).otherwise(F.col("closed_at"))).drop("closing")


def open_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """New sessions of requests (ord, tenant_id, user_id, meta)."""
    return requests.select(new_id("sess_", F.col("ord"), F.col("user_id"), now).alias("id"), "tenant_id", "user_id", F.lit("open").alias("status"), F.coalesce(F.to_json("meta"), F.lit("{}")).alias("meta_json"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("closed_at"))
