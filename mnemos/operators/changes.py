"""Changes of memories and vectors: soft and hard deletes, use counts, weights, pins, cached session items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions.scoring import effective_score
from mnemos.functions.vector import small

LEAST_WEIGHT, MOST_WEIGHT = 0.05, 3.0
#: Neighbouring steps that are put together at a time.
FOLD = 4_096


def soft_delete(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Every memory, with deleted_at and updated_at set on listed ones that are neither pinned nor deleted, and `changed`."""
    marked = memories.join(small(ids.select("id").distinct().withColumn("listed", F.lit(True))), "id", "left")
    hit = F.coalesce(F.col("listed"), F.lit(False)) & F.col("deleted_at").isNull() & ~F.coalesce(F.col("pinned"), F.lit(False))
    return marked.withColumn("changed", hit).withColumn("deleted_at", F.when(F.col("changed"), now).otherwise(F.col("deleted_at"))).withColumn("updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at"))).drop("listed")


def drop_vectors(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors without those of listed memories."""
    return embeddings.join(small(ids.select(F.col("id").alias("memory_id")).distinct()), "memory_id", "left_anti")


def touch(memories: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Active memories with one more access for each time that `used` (id) lists them, and the time of it."""
    counts = used.groupBy("id").agg(F.count("*").cast("int").alias("times"))
    met = memories.join(small(counts), "id", "left")
    hit = F.col("times").isNotNull() & F.col("deleted_at").isNull()
    return met.withColumn("access_count", F.when(hit, F.col("access_count") + F.col("times")).otherwise(F.col("access_count"))).withColumn("last_accessed_at", F.when(hit, now).otherwise(F.col("last_accessed_at"))).drop("times")


def _then(f: Column, g: Column) -> Column:
    """First f, then g: a step (a, low, high) takes x to x + a within low and high, and so do two steps, whatever x is."""
    within = lambda x: F.least(F.greatest(x + g["a"], g["low"]), g["high"])
    return F.struct((f["a"] + g["a"]).alias("a"), within(f["low"]).alias("low"), within(f["high"]).alias("high"))


def folded_deltas(deltas: DataFrame) -> DataFrame:
    """id and `step`: what all deltas (id, seq, delta) of a memory, in their order, do to its weight.

    Steps combine associatively: rows are dealt by range of id and seq, so a memory of many events is spread over tasks;
    FOLD neighbours are put together at a time, in three levels.
    """
    step = F.struct(F.col("delta").cast("double").alias("a"), F.lit(LEAST_WEIGHT).alias("low"), F.lit(MOST_WEIGHT).alias("high"))
    rows = deltas.where("delta <> 0").repartitionByRange("id", "seq").sortWithinPartitions("id", "seq").select("id", step.alias("step"), F.monotonically_increasing_id().alias("n"))
    none = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    for level in range(3):
        keys = ["id", F.floor(F.col("n") / FOLD).cast("long").alias("n")] if level < 2 else ["id"]
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "step"))), lambda x: x["step"])
        rows = rows.groupBy(*keys).agg(F.aggregate(ordered, none, _then).alias("step"))
    return rows


def adjust_weights(memories: DataFrame, deltas: DataFrame) -> DataFrame:
    """Active memories after the deltas (id, seq, delta) of theirs, applied one by one within 0.05 to 3."""
    met = memories.join(small(folded_deltas(deltas)), "id", "left")
    hit = F.col("step").isNotNull() & F.col("deleted_at").isNull()
    after = F.least(F.greatest(F.col("weight").cast("double") + F.col("step.a"), F.col("step.low")), F.col("step.high"))
    return met.withColumn("weight", F.when(hit, after).otherwise(F.col("weight"))).drop("step")


def decayed(memories: DataFrame, now: Column, threshold: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Active, unpinned memories whose effective score is below the threshold, with the score."""
    least = config.decay_delete_threshold if threshold is None else threshold
    score = effective_score(F.col("importance"), F.col("weight"), F.col("created_at"), now, F.coalesce("decay_lambda", F.lit(config.decay_lambda)))
    return memories.where("deleted_at IS NULL AND NOT pinned").withColumn("score", score).where(F.col("score") < least)


def forgettable(memories: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Active memories that consolidation forgets: light, unpinned, no identity and no summary."""
    return memories.where("deleted_at IS NULL AND NOT pinned").where((F.col("weight") < config.forget_threshold) & (F.col("memory_type") != "identity") & (F.col("source") != "consolidation"))


def evict(items: DataFrame, keep: int | Column) -> DataFrame:
    """Cached items of each session with `place`, and `kept`: the `keep` most important ones (newer, then earlier)."""
    order = Window.partitionBy("session_id").orderBy(F.desc(F.col("importance") * F.col("weight")), F.desc("created_at"), "seq")
    return items.withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= keep)


def set_pinned(memories: DataFrame, pins: DataFrame, now: Column) -> DataFrame:
    """Memories with the pins (id, pin) of listed active ones; `repinned` marks those, whose vectors are to be made anew."""
    met = memories.join(small(pins.select("id", "pin")), "id", "left")
    hit = F.col("pin").isNotNull() & F.col("deleted_at").isNull()
    return met.withColumn("repinned", hit).withColumn("pinned", F.when(hit, F.col("pin")).otherwise(F.col("pinned"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("pin")
