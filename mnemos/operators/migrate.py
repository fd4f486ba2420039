"""Re-embedding of memories after a change of model, and removal of vectors without a memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.operators.ingest import embedded
from mnemos.operators.lookup import active, orphan, vector_meta
from mnemos.sources.scratch import kept
from mnemos.sources.store import SnapshotStore, Transaction, merge

POLICIES = ("assign", "skip", "fail")


def plan(memories: DataFrame, embeddings: DataFrame, model: str, dim: int, orphan_policy: str = "skip", orphan_user: str | None = None, force: bool = False, user_id: str | None = None) -> DataFrame:
    """Active memories (of one user, or all) with `action`: embed, current or orphan_skipped, and `assigned`."""
    if orphan_policy not in POLICIES:
        raise ValueError(f"orphan_policy is one of {', '.join(POLICIES)}")
    if orphan_policy == "assign" and not orphan_user:
        raise ValueError("orphan_policy assign needs a user")
    rows = active(memories)
    if user_id is not None:
        rows = rows.where((F.col("user_id") == user_id) | orphan(F.col("user_id")))
    lone = orphan(F.col("user_id"))
    if orphan_policy == "fail" and not rows.where(lone).isEmpty():
        raise ValueError("there are memories without a user")
    rows = rows.withColumn("assigned", lone & F.lit(orphan_policy == "assign")).withColumn("user_id", F.when(lone & F.lit(orphan_policy == "assign"), F.lit(orphan_user)).otherwise(F.col("user_id")))
    meta = vector_meta(embeddings).select(F.col("memory_id").alias("id"), F.col("user_id").alias("v_user"), F.col("model").alias("v_model"), F.col("dim").alias("v_dim"))
    current = F.col("v_user").eqNullSafe(F.col("user_id")) & F.col("v_model").eqNullSafe(F.lit(model)) & F.col("v_dim").eqNullSafe(F.lit(dim))
    action = F.when(orphan(F.col("user_id")), "orphan_skipped").when(current & F.lit(not force), "current").otherwise("embed")
    return rows.join(meta, "id", "left").withColumn("action", action).drop("v_user", "v_model", "v_dim")


def dangling(embeddings: DataFrame, memories: DataFrame, user_id: str | None = None) -> DataFrame:
    """Vectors whose memory isn't active or has no user; of one user only if one is named."""
    scope = embeddings if user_id is None else embeddings.where(F.col("user_id") == user_id)
    kept = active(memories, orphans=False).select(F.col("id").alias("memory_id"))
    return scope.join(kept, "memory_id", "left_anti")


def reembed(memories: DataFrame, embeddings: DataFrame, now: Column, config: EngineConfig = DEFAULT, dry_run: bool = False, cleanup: bool = True, embed=None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, embeddings, one report row) after re-embedding what isn't current."""
    rows = plan(memories, embeddings, config.embedding_model, config.embedding_dim, **options)
    todo = rows.where("action = 'embed'")
    owned = merge(memories, rows.where("assigned").withColumn("updated_at", now).select(*memories.columns), ["id"])
    lost = dangling(embeddings, owned, options.get("user_id")) if cleanup else embeddings.where("false")
    numbers = rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("action") == "embed").alias("reembedded"), F.count_if(F.col("action") == "current").alias("skipped"), F.count_if(F.col("action") == "orphan_skipped").alias("orphans_skipped"), F.count_if("assigned").alias("orphans_assigned"))
    report = numbers.crossJoin(lost.agg(F.count("*").alias("dangling_removed"))).withColumn("target_model", F.lit(config.embedding_model)).withColumn("target_dim", F.lit(config.embedding_dim)).withColumn("dry_run", F.lit(dry_run))  # one row each
    if dry_run:
        return memories, embeddings, report
    fresh = embedded(todo, now, config, embed)
    return owned, merge(embeddings.join(lost.select("memory_id"), "memory_id", "left_anti"), fresh, ["memory_id"]), report


def reembed_in_parts(store: SnapshotStore, now: Column, run: str, config: EngineConfig = DEFAULT, part_rows: int = 100_000, most_parts: int | None = None, recreate: bool = False, cleanup: bool = True, embed=None, **options) -> dict[str, int | bool]:
    """Re-embed in parts of about part_rows rows, each a commit of its own that also says in `reembed_parts` that it is done.

    A run that was stopped, or that most_parts ended, goes on under the same name where it was; parts are told by a hash of
    ids, so they stay the same whatever was embedded meanwhile. recreate: drop all vectors of another size than the target's
    first. Returns the run's counts so far, and whether it is finished.
    """
    known = store.read("reembed_parts").where(F.col("run") == run)
    first = known.first()
    model, dim = config.embedding_model, config.embedding_dim

    def todo(own: Transaction) -> DataFrame:
        return plan(own.read("memories"), own.read("embeddings"), model, dim, **options).where("action = 'embed'")

    parts = first["parts"] if first else max(1, -(-store.transact(lambda own: todo(own).count()) // part_rows))
    done = {r["part"] for r in known.select("part").collect()}

    def told(own: Transaction, part: int, **counts: int) -> None:
        row = (f"{run}:{part}", run, part, parts, counts.get("reembedded", 0), counts.get("orphans_assigned", 0), counts.get("dangling_removed", 0))
        columns = "id string, run string, part int, parts int, reembedded long, orphans_assigned long, dangling_removed long"
        own.upsert("reembed_parts", store.spark.createDataFrame([row], columns).withColumn("created_at", now))

    def embed_part(own: Transaction, part: int) -> None:
        rows = kept(todo(own).where(F.crc32(F.col("id").cast("binary")) % parts == part))
        n = rows.agg(F.count("*").alias("n"), F.count_if("assigned").alias("assigned")).first()
        owners = rows.where("assigned").withColumn("updated_at", now)
        own.upsert("memories", owners)
        own.upsert("embeddings", embedded(rows, now, config, embed))
        told(own, part, reembedded=n["n"], orphans_assigned=n["assigned"])

    def start(own: Transaction) -> None:
        own.delete("embeddings", own.read("embeddings").where(F.col("dim") != dim).select("memory_id"))
        told(own, -1)

    def finish(own: Transaction) -> None:
        lost = dangling(own.read("embeddings"), own.read("memories"), options.get("user_id")).select("memory_id") if cleanup else own.read("embeddings").where("false").select("memory_id")
        lost = kept(lost)
        own.delete("embeddings", lost)
        told(own, parts, dangling_removed=lost.count())

    steps = ([(-1, start)] if recreate else []) + [(k, lambda own, k=k: embed_part(own, k)) for k in range(parts)] + [(parts, finish)]
    left = [s for s in steps if s[0] not in done]
    for _, step in left[:most_parts]:
        store.transact(step)
    sums = store.read("reembed_parts").where(F.col("run") == run).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reembedded", "orphans_assigned", "dangling_removed")]).first().asDict()
    return sums | {"finished": most_parts is None or len(left) <= most_parts}
