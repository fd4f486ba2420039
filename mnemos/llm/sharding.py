"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) has a uniform number u in (0, 1) out of MD5, one digest for four shards; the key goes to the shard
with the least -ln(u) / weight, the lowest number among equals. A shard's share is its weight's share, and a further
shard takes keys only into itself: the others' numbers stay as they are. Only DataFrame functions are used.

Places (slots) in a shard are counted in two steps, so no task sorts a whole shard: rows are numbered in buckets
of each shard, and the buckets' counts, a table of shards x buckets rows, are summed up and joined back.

Null keys hash as one key of their own (all such rows go to one shard, as do rows with equal keys), null texts have
no bytes, repeated rows get slots of their own. An empty table stays empty. A column that has the name of a new one stays,
and the new one gets '_' before its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.common import free_name, materialise

WORDS = 4
#: Parts of a shard whose rows are sorted together.
BUCKETS = 1024


def uniform_words(key: Column, shards: int) -> Column:
    """An array of `shards` or a few more integers from 0 to 2^32 - 1 for a string key."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((shards - 1) // WORDS)), lambda g: F.md5(F.concat(key, F.lit(":"), g.cast("string"))))
    words = F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.conv(F.substr(d, w * 8 + 1, F.lit(8)), 16, 10).cast("bigint")))
    return F.flatten(words)


def rendezvous(words: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(u) / weight among the first len(weights)."""
    known = F.array(*[F.lit(float(w)) for w in weights])
    score = lambda x, i: F.struct((-F.ln((x.cast("double") + 0.5) / F.lit(4294967296.0)) / F.get(known, i)).alias("s"), i.alias("shard"))
    return F.array_min(F.transform(F.slice(words, 1, len(weights)), score))["shard"]


def assign(docs: DataFrame, key: Column, weights: Sequence[float], shard_col: str = "shard", grown_col: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """docs with the shard of each key and, if grown_col is named, its shard if one more of grown_weight is there."""
    if not weights or min(weights) <= 0 or grown_weight <= 0:
        raise ValueError("weights have to be above 0")
    shard_col = free_name(docs.columns, shard_col)
    grown_col = grown_col and free_name([*docs.columns, shard_col], grown_col)
    words = free_name([*docs.columns, shard_col, grown_col or ""], "words")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    count = len(weights) + (grown_col is not None)
    out = docs.withColumn(words, uniform_words(text, count))
    out = out.withColumn(shard_col, rendezvous(F.col(words), weights))
    if grown_col:
        out = out.withColumn(grown_col, rendezvous(F.col(words), [*weights, grown_weight]))
    return out.drop(words)


def number(rows: DataFrame, shard_col: str, order: Sequence[Column], spread: Column, slot_col: str = "slot", buckets: int = BUCKETS) -> DataFrame:
    """rows with gapless places from 0 in their shard, by bucket (the integer `spread` modulo buckets), then order.

    Equal rows are counted first and get consecutive places, so neither a shard with a third of all rows nor a row that is
    repeated as often meets in one task; they are written, so they are hashed once. The offsets are shards x buckets rows at
    most, which is what is broadcast.
    """
    slot_col = free_name(rows.columns, slot_col)
    bucket, offset, n = (free_name([*rows.columns, slot_col], x) for x in ("bucket", "offset", "n"))
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias(n)).withColumn(bucket, F.pmod(F.coalesce(spread, F.lit(0)), F.lit(buckets)))
    groups = materialise(groups, "sharded")
    counts = groups.groupBy(shard_col, bucket).agg(F.sum(n).alias(n))
    before = Window.partitionBy(shard_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard_col, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    own = Window.partitionBy(shard_col, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn(slot_col, F.coalesce(F.sum(n).over(own), F.lit(0)))
    joined = placed.join(F.broadcast(offsets), [shard_col, bucket])
    first = F.col(slot_col) + F.col(offset)
    return joined.withColumn(slot_col, F.explode(F.sequence(first, first + F.col(n) - 1))).drop(bucket, offset, n)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """documents in 40 shards of equal weight by the law `key`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(rows, F.col("doc_id"), [1.0] * 40, grown_col="grown_shard")
    slots = number(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.pmod(F.col("doc_id"), F.lit(BUCKETS)) + F.col("text_crc32") % BUCKETS)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
