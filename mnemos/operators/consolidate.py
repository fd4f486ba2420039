"""Consolidation of all users' memories at once: reweight, retire conflicts, cluster and compress, forget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions import vocabulary as V
from mnemos.functions.text import bigrams, has_any, matching, overlap, strip, tokens
from mnemos.functions.vector import small
from mnemos.operators import stars
from mnemos.operators.graph import new_id
from mnemos.operators.lookup import active, recent_order
from mnemos.sources.scratch import kept

WEIGHT_STEP = 1e-4
NEGATED_OVERLAP = 0.25
FRAGMENTS = 4


def reweighted(memories: DataFrame, now: Column, config: EngineConfig = DEFAULT) -> DataFrame:
    """Active memories with new_weight and `changed`; weight and updated_at follow where the change is large enough."""
    used = F.coalesce("last_accessed_at", "updated_at", "created_at")
    rows = active(memories).withColumn("new_weight", S.reweight(F.col("importance"), used, F.col("access_count"), F.col("pinned"), now, config))
    rows = rows.withColumn("changed", F.abs(F.col("new_weight") - F.col("weight")) >= WEIGHT_STEP)
    return rows.withColumn("weight", F.when(F.col("changed"), F.col("new_weight")).otherwise(F.col("weight"))).withColumn("updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at")))


def keys(text: Column) -> Column:
    """Distinct tokens of two characters or more and their CJK bigrams."""
    return F.array_distinct(F.flatten(F.transform(tokens(text, 2), lambda t: F.concat(F.array(t), bigrams(t)))))


def topic_conflict(a: Column, b: Column, topic: Column, config: EngineConfig = DEFAULT) -> Column:
    """Whether two texts disagree on a topic: other databases, other languages, or a negation with words in common."""
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & (F.array_sort(x) != F.array_sort(y))

    def spoken(text: Column) -> Column:
        go = F.when(F.lower(text).rlike(r"(?U)\bgo\b"), F.array(F.lit("golang"))).otherwise(F.array().cast("array<string>"))
        return F.array_union(matching(text, config.languages), go)

    negated = F.concat(F.lower(a), F.lower(b)).rlike(config.conflict_negation) & (overlap(keys(a), keys(b)) >= NEGATED_OVERLAP)
    return F.when(topic == "database", apart(matching(a, config.databases), matching(b, config.databases))).when(topic == "backend_lang", apart(spoken(a), spoken(b))).otherwise(negated)


def conflicts(memories: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """user_id, topic, winner and loser id of every conflict; a row may lose in several topics.

    The winner of a user's topic comes from a maximum that is joined back, so no task sorts a topic's rows.
    """
    rows = active(memories).withColumn("topic", F.explode(matching(F.col("content"), config.topics)))
    rank = F.struct(F.col("pinned"), (F.col("source") == "reflection").alias("reflected"), F.col("weight"), F.coalesce("updated_at", "created_at").alias("at"), F.col("id"), F.col("content"))
    winners = rows.groupBy("user_id", "topic").agg(F.max(rank).alias("w"), F.count("*").alias("n")).where("n > 1").select("user_id", "topic", F.col("w.id").alias("winner"), F.col("w.content").alias("kept"))
    met = rows.join(small(winners), ["user_id", "topic"]).where("NOT pinned AND id <> winner")
    return met.where(topic_conflict(F.col("kept"), F.col("content"), F.col("topic"), config)).select("user_id", "topic", "winner", F.col("id").alias("loser"))


def candidates(memories: DataFrame) -> DataFrame:
    """What may be compressed, with its place among a user's rows."""
    rows = active(memories).where("NOT pinned").where(F.col("memory_type").isin("fact", "episode"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*recent_order())))


def topic_clusters(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """rows with `topic`: each row's first topic in which enough rows are left that no earlier topic took (else null).

    A user's rows are counted by their set of topics first; which topics take which sets follows from those few counts. The rows
    are written once, since what follows reads them several times.
    """
    marked = kept(rows.withColumn("topics", matching(F.col("content"), config.topics)))
    sets = marked.groupBy("user_id", "topics").agg(F.count("*").alias("n"))
    taken = F.lit(None).cast("string")
    for topic in config.topics:
        free = F.array_contains("topics", F.lit(topic)) & taken.isNull()
        sets = sets.withColumn(f"n_{topic}", F.sum(F.when(free, F.col("n")).otherwise(0)).over(Window.partitionBy("user_id")))
        taken = F.when(taken.isNotNull(), taken).when(free & (F.col(f"n_{topic}") >= config.cluster_min_size), F.lit(topic))
    return marked.join(small(sets.select("user_id", "topics", taken.alias("topic"))), ["user_id", "topics"]).drop("topics")


def star_clusters(rows: DataFrame, config: EngineConfig = DEFAULT, **sizes: int) -> DataFrame:
    """user_id, id and cluster (place of its first row) by greedy stars in the order of places (see mnemos.operators.stars).

    rows: user_id, id, place, content, vector.
    """
    return stars.star_clusters(rows.select("user_id", "id", "place", "vector", keys(F.col("content")).alias("words")), config, **sizes)


def clusters(memories: DataFrame, embeddings: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Candidates with `cluster` (text): topics first, then stars of the rest, max_clusters of each user in all."""
    rows = topic_clusters(candidates(memories), config)
    by_topic = rows.where("topic IS NOT NULL").withColumn("cluster", F.concat(F.lit("t:"), "topic")).drop("topic")
    rest = rows.where("topic IS NULL").drop("topic")
    vectors = embeddings.select(F.col("memory_id").alias("id"), "vector")
    by_star = star_clusters(rest.join(vectors, "id", "left"), config).select("id", F.concat(F.lit("s:"), F.lpad(F.col("cluster").cast("string"), 12, "0")).alias("cluster"))
    met = by_topic.unionByName(rest.join(by_star, "id"))
    order = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.when(F.col("cluster").startswith("t:"), 0).otherwise(1), _topic_place(config), "cluster"))
    return met.withColumn("n", order).where(F.col("n") <= config.max_clusters).drop("n")


def _topic_place(config: EngineConfig) -> Column:
    place = F.lit(0)
    for i, topic in enumerate(config.topics):
        place = F.when(F.col("cluster") == f"t:{topic}", i).otherwise(place)
    return place


def summaries(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """user_id, cluster, summary, topic, members, importance and weight of each cluster.

    A summary has the first four fragments of different beginnings (48 characters without white space), longest first.
    """
    text = strip(F.col("content"))
    key = F.substring(F.regexp_replace(F.lower("content"), r"(?U)\s+", ""), 1, 48)
    topics = rows.groupBy("user_id", "cluster").agg(*[F.max(has_any(F.col("content"), words)).alias(f"has_{t}") for t, words in config.topics.items()], F.max("importance").alias("importance"), F.max("weight").alias("weight"), F.count("*").alias("members"))
    guess = F.coalesce(*[F.when(F.col(f"has_{t}"), F.lit(t)) for t in config.topics], F.lit(V.DEFAULT_TOPIC))
    own = rows.where(F.length(text) > 0).select("user_id", "cluster", "place", text.alias("text"), key.alias("key"), F.length("content").alias("n"))
    first = Window.partitionBy("user_id", "cluster", "key").orderBy(F.desc("n"), "place")
    top = Window.partitionBy("user_id", "cluster").orderBy(F.desc("n"), "place")
    picked = own.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("r", F.row_number().over(top)).where(F.col("r") <= FRAGMENTS)
    joined = picked.groupBy("user_id", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), V.FRAGMENT_JOIN).alias("fragments"))
    out = topics.withColumn("topic", guess).join(joined, ["user_id", "cluster"], "left")
    before, after = V.SUMMARY_PREFIX.split("{}")
    return out.select("user_id", "cluster", F.concat(F.lit(before), "topic", F.lit(after), F.coalesce("fragments", F.lit(""))).alias("summary"), "topic", "members", "importance", "weight")


def summary_memories(made: DataFrame, now: Column) -> DataFrame:
    """The memories that summaries become."""
    return made.select(
        new_id("mem_", F.lit("summary"), F.col("user_id"), F.col("cluster"), F.col("summary")).alias("id"), "user_id", F.col("summary").alias("content"), F.lit("fact").alias("memory_type"),
        F.greatest("importance", F.lit(0.75)).alias("importance"), "weight", F.lit(False).alias("pinned"), F.lit("consolidation").alias("source"), now.alias("created_at"), now.alias("updated_at"), F.lit(0).alias("access_count"),
    )


def consolidate(memories: DataFrame, embeddings: DataFrame, now: Column, config: EngineConfig = DEFAULT, keep=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, embeddings, report by user) after all four stages.

    keep(df, name) writes and rereads a stage's result, to cut lineage; by default it goes to the shared checkpoint folder.
    """
    from mnemos.operators.changes import drop_vectors, forgettable, soft_delete
    from mnemos.sources.store import merge

    if keep is None:
        keep = lambda df, name: kept(df)
    light = reweighted(memories, now, config)
    touched = light.where("changed").groupBy("user_id").agg(F.count("*").alias("reweighted"))
    rows = keep(merge(memories, light.select(*memories.columns), ["id"]), "reweighted")
    lost = keep(conflicts(rows, config), "conflicts")
    retired = lost.groupBy("user_id").agg(F.countDistinct("loser").alias("conflicts_resolved"))
    rows = keep(soft_delete(rows, lost.select(F.col("loser").alias("id")), now).drop("changed").select(*memories.columns), "resolved")
    vectors = drop_vectors(embeddings, lost.select(F.col("loser").alias("id")))
    grouped = keep(clusters(rows, vectors, config), "clusters")
    made = summaries(grouped, config)
    squeezed = grouped.groupBy("user_id").agg(F.countDistinct("cluster").alias("compressed_clusters"), F.count("*").alias("compressed_deleted"))
    rows = soft_delete(rows, grouped.select("id"), now).drop("changed").select(*memories.columns)
    rows = keep(rows.unionByName(summary_memories(made, now), allowMissingColumns=True), "compressed")
    vectors = drop_vectors(vectors, grouped.select("id"))
    gone = keep(forgettable(rows, config).select("id", "user_id"), "forgotten")
    forgotten = gone.groupBy("user_id").agg(F.count("*").alias("forgotten"))
    rows = soft_delete(rows, gone, now).drop("changed").select(*memories.columns)
    vectors = drop_vectors(vectors, gone)
    report = active(memories, orphans=False).select("user_id").distinct()
    for part in (touched, retired, squeezed, forgotten):
        report = report.join(part, "user_id", "left")
    return rows, vectors, report.na.fill(0)


COUNTERS = ("reweighted", "conflicts_resolved", "compressed_clusters", "compressed_deleted", "forgotten")


def totals(report: DataFrame) -> DataFrame:
    """One row: users, and the sums of all counters over their reports (zeros for an empty report)."""
    return report.agg(*_sums())


def observed(report: DataFrame) -> tuple[DataFrame, Observation]:
    """The report, and the same totals as metrics of the job that first reads it to its end."""
    seen = Observation()
    return report.observe(seen, *_sums()), seen


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("users"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS]]
