"""Hybrid recall and recommendations for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions.text import hit_score, lexical_similarity, query_keys, tokens
from mnemos.functions.vector import cosine, hinted, nearest, norm, rows_of
from mnemos.operators.index import VectorIndex
from mnemos.operators.lookup import active, newest_by_user

QUERY_DEFAULTS = {"session_id": "string", "tenant_id": "string", "top_k": "int", "include_pinned": "boolean", "min_score": "double"}


def prepared(queries: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """queries (query_id, user_id, query, vector) with all options filled in, tokens and the vector's norm."""
    for name, kind in QUERY_DEFAULTS.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return (
        queries.withColumn("top_k", F.coalesce("top_k", F.lit(config.recall_top_k)))
        .withColumn("include_pinned", F.coalesce("include_pinned", F.lit(True)))
        .withColumn("min_score", F.coalesce("min_score", F.lit(config.min_score)))
        .withColumn("tokens", tokens(F.col("query")))
        .withColumn("qn", norm(F.col("vector")))
    )


def _visible(tenant: Column, own: Column) -> Column:
    return tenant.isNull() | tenant.eqNullSafe(own)


def recall(queries: DataFrame, memories: DataFrame, embeddings: DataFrame, now: Column, l1_items: DataFrame | None = None, config: EngineConfig = DEFAULT, index: VectorIndex | None = None) -> DataFrame:
    """The best memories for each query: query_id, id, content, memory_type, pinned, layer, score, relevance, lexical,

    vector_sim and rank. Vector hits are cut before deleted rows and other tenants go, as slots are theirs; then come
    pinned rows of the user, then the session's cached items (with `vector`, if they are embedded), each id once. index: of
    the embeddings; without one all vectors of the users are scored.
    """
    q, few = prepared(queries, config), rows_of(queries)
    hits, k = _hits(q, index or embeddings, few, None if "top_k" in queries.columns else 3 * config.recall_top_k)
    rows = active(memories).select("id", "user_id", "tenant_id", "content", "memory_type", "importance", "weight", "pinned", "decay_lambda", "created_at", "updated_at")
    asked = q.select("query_id", F.col("tenant_id").alias("asked_tenant"), F.col("user_id").alias("asked_user"), "tokens", "qn", "vector", "include_pinned", "min_score", "top_k", "session_id")
    vector_side = rows.join(hinted(hits, few * k), rows["id"] == hits["memory_id"]).drop("memory_id").withColumn("tier", F.lit(0))
    vector_side = vector_side.select("query_id", *rows.columns, F.col("similarity").alias("sim"), F.col("rank").alias("order"), "tier")
    pins = newest_by_user(memories, config.pinned_cap, pinned_only=True).select(*rows.columns, F.col("place").alias("order"))
    vectors = embeddings.select(F.col("memory_id").alias("id"), F.col("vector").alias("v"))
    pins = pins.join(vectors, "id", "left")
    pin_side = pins.join(hinted(q.where("include_pinned").select("query_id", "user_id", F.col("vector").alias("qv"), "qn"), few), "user_id")
    same = F.size("qv") == F.size("v")
    pin_side = pin_side.select("query_id", *rows.columns, F.when(same, cosine(F.col("qv"), F.col("v"), F.col("qn"))).otherwise(0.0).alias("sim"), "order", F.lit(1).alias("tier"))
    sides = vector_side.unionByName(pin_side)
    if l1_items is not None:
        items = l1_items.withColumn("v", F.col("vector") if "vector" in l1_items.columns else F.lit(None).cast("array<float>"))
        met = items.join(hinted(q.select("query_id", F.col("user_id").alias("asked"), "session_id", F.col("vector").alias("qv"), "qn"), few), "session_id").where(F.col("user_id").eqNullSafe(F.col("asked")))
        extra = met.select(
            "query_id", "id", "user_id", "tenant_id", "content", "memory_type", "importance", "weight", "pinned",
            F.lit(None).cast("double").alias("decay_lambda"), "created_at", F.col("created_at").alias("updated_at"),
            F.when(F.size("qv") == F.size("v"), cosine(F.col("qv"), F.col("v"), F.col("qn"))).otherwise(0.0).alias("sim"), F.col("seq").cast("int").alias("order"), F.lit(2).alias("tier"),
        )
        sides = sides.unionByName(extra)
    met = sides.join(hinted(asked, few), "query_id").where((F.col("tier") == 2) | _visible(F.col("asked_tenant"), F.col("tenant_id")))
    once = Window.partitionBy("query_id", "id").orderBy("tier", "order")
    met = met.withColumn("n", F.row_number().over(once)).where("n = 1")
    base = S.effective_score(F.col("importance"), F.col("weight"), F.col("created_at"), now, F.coalesce("decay_lambda", F.lit(config.decay_lambda)))
    scored = met.withColumn("vector_sim", S.clamp(F.col("sim"), 0.0, 1.0)).withColumn("lexical", lexical_similarity(F.col("content"), F.col("tokens")))
    scored = scored.withColumn("relevance", S.relevance(F.col("vector_sim"), F.col("lexical"), config.vector_weight)).withColumn("score", S.blend(base, F.col("relevance")))
    gated = scored.where(S.passes(F.col("score"), F.col("lexical"), F.col("min_score"), config.min_score_no_lexical)).where("include_pinned OR NOT pinned")
    boosted = F.col("score") + F.when(F.col("pinned") & F.col("include_pinned"), F.lit(config.pinned_boost)).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(boosted.desc(), "tier", "order", "id")
    ranked = gated.withColumn("rank", F.row_number().over(order)).where("rank <= top_k")
    return ranked.select("query_id", "id", "content", "memory_type", "pinned", F.when(F.col("tier") < 2, "L2").otherwise("L1").alias("layer"), "score", "relevance", "lexical", "vector_sim", "rank")


def _hits(q: DataFrame, embeddings: DataFrame | VectorIndex, few: int, k: int | None, least: int = 20) -> tuple[DataFrame, int]:
    """Vector hits of each query, three times its top_k (`least` at least), and the most that a query has."""
    options = q.select("query_id", F.greatest(3 * F.col("top_k"), F.lit(least)).alias("k"))
    most = int(options.agg(F.max("k")).first()[0] or 0) if k is None else max(k, least)
    own = q.select("query_id", "user_id", "vector")
    hits = embeddings.search(own, most, rows=few) if isinstance(embeddings, VectorIndex) else nearest(own, embeddings, most, rows=few)
    return hits.join(hinted(options, few), "query_id").where("rank <= k").drop("k"), most


def recommend(queries: DataFrame, memories: DataFrame, embeddings: DataFrame | VectorIndex, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, memory_id, content, score, tier and rank of recommended memories.

    queries: query_id, user_id, query, vector, and maybe exclude (array of ids), top_k, tenant_id. First vector hits in
    their order, then recent rows by words; each at least at the threshold, top_k in all.
    """
    q = queries
    for name, kind in (("exclude", "array<string>"), ("top_k", "int"), ("tenant_id", "string")):
        if name not in q.columns:
            q = q.withColumn(name, F.lit(None).cast(kind))
    if not config.recommend_enabled:
        q = q.where("false")
    q = q.where(F.col("user_id").isNotNull() & F.col("query").rlike(r"(?U)\S")).withColumn("top_k", F.coalesce("top_k", F.lit(config.recommend_top_k))).withColumn("keys", query_keys(F.col("query")))
    asked = q.select("query_id", F.col("tenant_id").alias("asked_tenant"), F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude"), "top_k", "keys")
    few = rows_of(queries)
    hits, k = _hits(q, embeddings, few, None if "top_k" in queries.columns else 3 * config.recommend_top_k, 10)
    rows = active(memories).select("id", "tenant_id", "content")
    near = rows.join(hinted(hits, few * k), rows["id"] == hits["memory_id"]).select("query_id", "id", "tenant_id", "content", "similarity", F.col("rank").cast("double").alias("order"), F.lit(1).alias("tier"))
    recent = newest_by_user(memories, config.scan_limit).select("user_id", "id", "tenant_id", "content", "place")
    words = recent.join(hinted(q.select("query_id", "user_id"), few), "user_id").select("query_id", "id", "tenant_id", "content", F.lit(0.0).alias("similarity"), F.col("place").cast("double").alias("order"), F.lit(2).alias("tier"))
    both = near.unionByName(words).join(hinted(asked, few), "query_id").where(_visible(F.col("asked_tenant"), F.col("tenant_id")) & ~F.array_contains("exclude", F.col("id")))
    scored = both.withColumn("score", F.greatest(F.lit(0.0), F.col("similarity"), hit_score(F.col("keys"), F.col("content")))).where(F.col("score") >= config.recommend_min_score)
    once = Window.partitionBy("query_id", "id").orderBy("tier")
    scored = scored.withColumn("n", F.row_number().over(once)).where("n = 1")
    order = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 1, F.col("order")).otherwise(-F.col("score")), "order", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= top_k").select("query_id", F.col("id").alias("memory_id"), "content", "score", "tier", "rank")
