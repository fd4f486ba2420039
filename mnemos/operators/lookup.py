"""Reads: lookups in order, active rows, newest rows of each user, entities by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.text import normal_name
from mnemos.functions.vector import small
from mnemos.operators.trigrams import TrigramIndex


def active(memories: DataFrame, user_id: str | None = None, tenant_id: str | None = None, orphans: bool = True, limit: int | None = None) -> DataFrame:
    """Rows that aren't deleted, newest first if a limit is given."""
    out = memories.where("deleted_at IS NULL")
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    if tenant_id is not None:
        out = out.where(F.col("tenant_id") == tenant_id)
    if not orphans:
        out = out.where(~orphan(F.col("user_id")))
    return out.orderBy(F.desc("updated_at"), "id").limit(limit) if limit is not None else out


def orphan(user_id: Column) -> Column:
    return user_id.isNull() | (user_id == "")


def recent_order() -> list[Column]:
    """Pinned first, then the newest; ids part ties."""
    return [F.desc("pinned"), F.desc("updated_at"), F.col("id")]


def newest_by_user(memories: DataFrame, limit: int, pinned_only: bool = False) -> DataFrame:
    """The first `limit` active rows of every user, with their place."""
    rows = active(memories)
    if pinned_only:
        rows = rows.where("pinned")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*recent_order()))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def users(memories: DataFrame) -> DataFrame:
    """Distinct users that have active rows."""
    return active(memories, orphans=False).select("user_id").distinct()


def by_ids(requests: DataFrame, table: DataFrame, ids_col: str = "ids", id_col: str = "id", request_id: str = "query_id") -> DataFrame:
    """Rows of listed ids with the place in their list: missing ids are skipped, repeated ones repeated, deleted rows kept."""
    wanted = requests.select(request_id, F.posexplode(ids_col).alias("pos", id_col))
    return table.join(small(wanted), id_col)


def vector_meta(embeddings: DataFrame) -> DataFrame:
    """Which model made each vector; vectors themselves aren't read."""
    return embeddings.select("memory_id", "user_id", "model", "dim")


def entity_names(entities: DataFrame) -> DataFrame:
    """Every normalised name and alias of the entities."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normal_name))
    return entities.select("user_id", "tenant_id", F.explode(names).alias("norm"), "id", "created_at")


def resolve(requests: DataFrame, entities: DataFrame, name_col: str = "name") -> DataFrame:
    """requests (with user_id, a name and maybe tenant_id) and entity_id, the oldest entity of that name or alias."""
    r = requests.withColumn("norm", normal_name(F.col(name_col)))
    n = entity_names(entities)
    if "tenant_id" in requests.columns:
        first = n.groupBy("user_id", "tenant_id", "norm").agg(F.min(F.struct("created_at", "id")).alias("first"))
        met = r.join(first.withColumnRenamed("tenant_id", "entity_tenant"), ["user_id", "norm"], "left")
        fits = F.col("tenant_id").isNull() | (F.col("tenant_id") == F.col("entity_tenant"))
        best = met.groupBy(*[F.col(c) for c in r.columns]).agg(F.min(F.when(fits, F.col("first"))).alias("first"))
    else:
        first = n.groupBy("user_id", "norm").agg(F.min(F.struct("created_at", "id")).alias("first"))
        best = r.join(first, ["user_id", "norm"], "left")
    return best.withColumn("entity_id", F.col("first")["id"]).drop("norm", "first")


def search_entities(entities: DataFrame, user_id: str | None = None, q: str | None = None, entity_type: str | None = None, tenant_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entities of a type whose normalised name holds the normalised query; the limit comes last."""
    out = entities
    for column, value in (("user_id", user_id), ("entity_type", entity_type), ("tenant_id", tenant_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if q:
        out = out.where(F.contains(normal_name(F.col("name")), normal_name(F.lit(q))))
    return out.orderBy("created_at", "id").limit(limit) if limit is not None else out


def search_entities_indexed(entities: DataFrame, index: TrigramIndex, requests: DataFrame) -> DataFrame:
    """request_id and id of the entities that fit each request (request_id, user_id, q, entity_type, tenant_id), any but the

    first null for all, through an index of normal_name(name) by entity id. For many requests; limits are the caller's.
    """
    asked = requests.withColumn("needle", F.coalesce(normal_name(F.col("q")), F.lit("")))
    own = asked.select("request_id", "needle", *[F.col(c).alias(f"asked_{c}") for c in ("user_id", "entity_type", "tenant_id")])
    met = index.containing(asked).join(own, "needle").join(entities, "id")
    fits = F.lit(True)
    for c in ("user_id", "entity_type", "tenant_id"):
        fits = fits & (F.col(f"asked_{c}").isNull() | (F.col(f"asked_{c}") == F.col(c)))
    return met.where(fits).select("request_id", "id", "name", "created_at")


def first_by(table: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("place", place).where("place = 1").drop("place")
