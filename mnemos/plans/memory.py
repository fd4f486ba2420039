"""Queries about memories: lookups, scores, vectors, recall, sessions, deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.config import EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions.text import hit_score, lexical_similarity, overlap, query_keys, tokens
from mnemos.functions.vector import hash_buckets, nearest
from mnemos.operators import changes, consolidate, lookup, migrate
from mnemos.operators import recall as R
from mnemos.operators.alerts import near_duplicates
from mnemos.operators.index import VectorIndex
from mnemos.operators.ingest import close, flagged, promotion
from mnemos.operators.trigrams import TrigramIndex
from mnemos.plans import views as V

QUERIES: dict = {}
ORACLES: dict = {}

#: The driver's memories are a year old and more: the gates are set so that some hits pass and others don't.
GATED = EngineConfig(decay_lambda=0.001, min_score=0.1, min_score_no_lexical=0.16)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(name: str, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


@query(f"WITH {V.MEMORIES_SQL} SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM memories WHERE deleted_at IS NULL) WHERE place <= 40")
def active_by_user_topn(spark, d):
    return lookup.newest_by_user(V.memories(spark, d), 40).select("user_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {V.MEMORIES_SQL} SELECT DISTINCT user_id FROM memories WHERE deleted_at IS NULL AND user_id IS NOT NULL AND user_id <> ''")
def distinct_users(spark, d):
    return lookup.users(V.memories(spark, d))


@query(f"WITH {V.MEMORIES_SQL} SELECT id, user_id, tenant_id FROM memories WHERE deleted_at IS NULL")
def active_memories(spark, d):
    return lookup.active(V.memories(spark, d)).select("id", "user_id", "tenant_id")


@query(f"WITH {V.MEMORIES_SQL} SELECT id FROM memories WHERE n % 10 = 9 AND deleted_at IS NULL")
def orphans(spark, d):
    rows = V.memories(spark, d).withColumn("user_id", F.expr("CASE WHEN n % 10 <> 9 THEN user_id WHEN n % 20 = 9 THEN '' END"))
    return lookup.active(rows).where(lookup.orphan(F.col("user_id"))).select("id")


@query(f"WITH {V.MEMORIES_SQL}, r AS (SELECT conv_id AS query_id, turn AS pos, concat('m', conv_id * 7 + turn // 2) AS id FROM conversations) SELECT query_id, pos, r.id, content FROM r JOIN memories USING (id)")
def lookup_by_ids_ordered(spark, d):
    listed = V.table(spark, d, "conversations").select("conv_id", "turn", F.expr("concat('m', conv_id * 7 + turn DIV 2)").alias("id"))
    wanted = listed.groupBy(F.col("conv_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("ids"))
    return lookup.by_ids(wanted, V.memories(spark, d)).select("query_id", F.col("pos").cast("long").alias("pos"), "id", "content")


ORACLES["lookup_by_ids_ordered"] = f"""
    WITH {V.MEMORIES_SQL},
         r AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, concat('m', conv_id * 7 + turn // 2) AS id FROM conversations)
    SELECT query_id, pos, id, content FROM r JOIN memories USING (id)
"""


@query(f"WITH {V.MEMORIES_SQL} SELECT id, round(importance * exp(-coalesce(decay_lambda, CAST(0.05 AS DOUBLE)) * {V.AGE_SQL.format('created_at', now=V.NOW_SQL)}) * weight, 9) AS score FROM memories")
def effective_score(spark, d):
    score = S.effective_score(F.col("importance"), F.col("weight"), F.col("created_at"), V.now(), F.coalesce("decay_lambda", F.lit(0.05)))
    return V.memories(spark, d).select("id", F.round(score, 9).alias("score"))


KNN = """
    SELECT query_id, memory_id, similarity, rank FROM (
        SELECT q.vec_id AS query_id, concat('m', e.vec_id) AS memory_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s, round(s, 6) AS similarity,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, concat('m', e.vec_id)) AS rank
        FROM embeddings q JOIN embeddings e ON {0} WHERE q.vec_id % 50 = 0) WHERE rank <= 10
"""


@query(KNN.format("q.label = e.label"))
def knn_per_label(spark, d):
    v = V.vectors(spark, d)
    q = v.where("n % 50 = 0").select(F.col("n").alias("query_id"), "user_id", "vector")
    return nearest(q, v, 10).select("query_id", "memory_id", r6("similarity"), F.col("rank").cast("long").alias("rank"))


@query(KNN.format("true"))
def knn_all_users(spark, d):
    v = V.vectors(spark, d).withColumn("user_id", F.lit("all"))
    q = v.where("n % 50 = 0").select(F.col("n").alias("query_id"), "user_id", "vector")
    return nearest(q, v, 10).select("query_id", "memory_id", r6("similarity"), F.col("rank").cast("long").alias("rank"))


@query(KNN.format("q.label = e.label"))
def knn_indexed(spark, d):
    """As knn_per_label, through an index of pivots."""
    v = V.vectors(spark, d)
    q = v.where("n % 50 = 0").select(F.col("n").alias("query_id"), "user_id", "vector")
    return VectorIndex.build(v).search(q, 10).select("query_id", "memory_id", r6("similarity"), F.col("rank").cast("long").alias("rank"))


@query(KNN.format("true"))
def knn_all_users_indexed(spark, d):
    v = V.vectors(spark, d).withColumn("user_id", F.lit("all"))
    q = v.where("n % 50 = 0").select(F.col("n").alias("query_id"), "user_id", "vector")
    return VectorIndex.build(v).search(q, 10).select("query_id", "memory_id", r6("similarity"), F.col("rank").cast("long").alias("rank"))


def recall_sql(config: EngineConfig, columns: str, gate: bool = True, l1: bool = False) -> str:
    base = f"c.importance * exp(-coalesce(c.decay_lambda, CAST({config.decay_lambda} AS DOUBLE)) * {V.AGE_SQL.format('c.created_at', now=V.NOW_SQL)}) * c.weight"
    gates = f"AND score >= {config.min_score} AND NOT (lexical <= 0 AND score < {config.min_score_no_lexical})" if gate else ""
    session = (
        "UNION ALL SELECT q.query_id, l.id, l.content, l.memory_type, l.importance, l.weight, l.pinned, NULL, l.created_at, CAST(0 AS DOUBLE), l.seq, 2, 'L1' FROM queries q JOIN l1 l ON l.session_id = CAST(q.query_id // 50 AS VARCHAR) AND l.user_id = q.user_id"
        if l1
        else ""
    )
    return f"""
    WITH {V.EMBEDDED_SQL}, {V.QUERIES_SQL}{", " + V.L1_SQL.replace("concat('u', conv_id % 5) AS user_id", "CAST(conv_id % 10 AS VARCHAR) AS user_id") if l1 else ""},
    vec AS (SELECT concat('m', vec_id) AS id, CAST(label AS VARCHAR) AS user_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    hits AS (SELECT * FROM (SELECT q.query_id, v.id, list_cosine_similarity(q.vector, v.v) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.vector, v.v) DESC, v.id) AS place FROM queries q JOIN vec v USING (user_id)) WHERE place <= 24),
    pins AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS place FROM embedded m WHERE deleted_at IS NULL AND pinned) WHERE place <= 20),
    sides AS (
        SELECT h.query_id, m.id, m.content, m.memory_type, m.importance, m.weight, m.pinned, m.decay_lambda, m.created_at, h.sim, h.place, 0 AS tier, 'L2' AS layer FROM hits h JOIN embedded m USING (id) WHERE m.deleted_at IS NULL
        UNION ALL SELECT q.query_id, p.id, p.content, p.memory_type, p.importance, p.weight, p.pinned, p.decay_lambda, p.created_at, list_cosine_similarity(q.vector, p.vector), p.place, 1, 'L2' FROM pins p JOIN queries q USING (user_id)
        {session}),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY tier, place) AS k FROM sides) WHERE k = 1),
    words AS (SELECT c.*, {V.TOKENS_SQL.format("q.query", 1)} AS toks FROM once c JOIN queries q USING (query_id)),
    scored AS (SELECT c.*, least(greatest(sim, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS vector_sim,
        CAST(len(list_filter(toks, lambda t: contains(lower(content), t))) AS DOUBLE) / len(toks) AS lexical,
        CAST(0.7 AS DOUBLE) * vector_sim + CAST(0.3 AS DOUBLE) * lexical AS relevance,
        ({base}) * (CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * relevance) AS score FROM words c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + CASE WHEN pinned THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END DESC, tier, place, id) AS rank FROM scored WHERE true {gates})
    SELECT {columns} FROM ranked WHERE rank <= 8
    """


FULL = "query_id, id, pinned, layer, round(score, 6) AS score, round(relevance, 6) AS relevance, round(lexical, 6) AS lexical, round(vector_sim, 6) AS vector_sim, rank"
OPEN = EngineConfig(decay_lambda=0.001, min_score=0.0, min_score_no_lexical=0.0)


def _recall(spark, d, config, l1=None, index=None):
    out = R.recall(V.queries(spark, d) if l1 is None else V.queries(spark, d).withColumn("session_id", F.expr("CAST(query_id DIV 50 AS STRING)")), V.embedded(spark, d), V.vectors(spark, d), V.now(), l1, config, index)
    return out.select("query_id", "id", "pinned", "layer", r6("score"), r6("relevance"), r6("lexical"), r6("vector_sim"), F.col("rank").cast("long").alias("rank"))


@query(recall_sql(OPEN, FULL, gate=False))
def recall_hybrid(spark, d):
    return _recall(spark, d, OPEN)


@query(recall_sql(OPEN, FULL, gate=False))
def recall_indexed(spark, d):
    """Hybrid recall whose vector hits come through an index of pivots."""
    return _recall(spark, d, OPEN, index=VectorIndex.build(V.vectors(spark, d)))


@query(recall_sql(GATED, FULL))
def recall_gated(spark, d):
    return _recall(spark, d, GATED)


@query(recall_sql(OPEN, FULL, gate=False, l1=True))
def recall_with_session(spark, d):
    items = V.l1_items(spark, d).withColumn("user_id", F.expr("CAST(session_id AS INT) % 10").cast("string"))
    return _recall(spark, d, OPEN, items)


def _asked(spark, d, **more):
    """Whole documents with each benchmark item whose number leaves the same rest, as questions; more: columns made of items before they meet documents."""
    q = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.expr("item_id % 40").alias("k"), *[c.alias(name) for name, c in more.items()])
    return V.memories(spark, d).select("id", "content", F.expr("n % 40").alias("k")).join(q, "k")


@query(f"""
    WITH {V.MEMORIES_SQL}, q AS (SELECT item_id, {V.TOKENS_SQL.format("text", 1)} AS toks FROM benchmark)
    SELECT id, item_id, round(CASE WHEN len(toks) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(list_filter(toks, lambda t: contains(lower(content), t))) AS DOUBLE) / len(toks) END, 6) AS lexical FROM memories m JOIN q ON m.n % 40 = q.item_id % 40
""")
def lexical_similarity_scores(spark, d):
    return _asked(spark, d).select("id", "item_id", r6("lexical", lexical_similarity(F.col("content"), tokens(F.col("query")))))


@query(f"""
    WITH t AS (SELECT conv_id, turn, list_distinct({V.TOKENS_SQL.format("text", 2)}) AS k FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) / len(list_distinct(list_concat(a.k, b.k))) END, 6) AS overlap
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def jaccard_overlap(spark, d):
    t = V.table(spark, d, "conversations").select("conv_id", "turn", consolidate.keys(F.col("text")).alias("k"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("kb"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", r6("overlap", overlap(F.col("k"), F.col("kb"))))


@query(f"""
    WITH t AS (SELECT doc_id, text, list_distinct({V.TOKENS_SQL.format("text", 2)}) AS k FROM documents),
    p AS (SELECT a.doc_id, a.text AS ta, b.text AS tb, a.k AS ka, b.k AS kb FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, trim(ta) = trim(tb) OR (len(ka) > 0 AND len(kb) > 0 AND CAST(len(list_filter(ka, lambda x: contains(lower(tb), x))) AS DOUBLE) / len(ka) >= 0.72
        AND CAST(len(list_filter(kb, lambda x: contains(lower(ta), x))) AS DOUBLE) / len(kb) >= 0.72) AS near_duplicate FROM p
""")
def near_duplicate_pairs(spark, d):
    """The predicate on each document and the one with the next id; the search for duplicates is mnemos.llm's."""
    a = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("ta"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("ta").alias("tb"))
    return near_duplicates(a.join(b, "doc_id"), "ta", "tb").select("doc_id", "near_duplicate")


@query(f"""
    WITH t AS (SELECT DISTINCT unnest({V.TOKENS_SQL.format("text", 12)}) AS needle FROM benchmark)
    SELECT needle, count(*) AS n_docs, max(doc_id) AS last FROM t JOIN documents ON contains(lower(text), needle) GROUP BY needle
""")
def text_search_indexed(spark, d):
    """In which documents each long word of the benchmark occurs, as a part of a word or whole, through an index of trigrams."""
    words = V.table(spark, d, "benchmark").select(F.explode(tokens(F.col("text"), 12)).alias("needle"))
    index = TrigramIndex.build(V.table(spark, d, "documents"), "doc_id", F.lower("text"))
    return index.containing(words).groupBy("needle").agg(F.count("*").alias("n_docs"), F.max("id").alias("last"))


@query(f"""
    WITH {V.MEMORIES_SQL}, q AS (SELECT item_id, list_distinct({V.TOKENS_SQL.format("text", 2)}) AS k FROM benchmark)
    SELECT id, item_id, round(CASE WHEN len(k) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(list_filter(k, lambda x: contains(lower(content), x))) AS DOUBLE) / len(k) END, 6) AS hit FROM memories m JOIN q ON m.n % 40 = q.item_id % 40
""")
def lexical_hit_scores(spark, d):
    return _asked(spark, d, keys=query_keys(F.col("text"))).select("id", "item_id", r6("hit", hit_score(F.col("keys"), F.col("content"))))


@query(f"""
    WITH {V.MEMORIES_SQL}, h AS (SELECT *, len(list_filter(['api', 'redis', 'sqlite', 'postgres', 'fastapi'], lambda p: contains(lower(content), p))) AS f, length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) AS n_chars FROM memories)
    SELECT id, round(CASE WHEN pinned THEN CAST(1 AS DOUBLE) ELSE least(greatest(
        CASE memory_type WHEN 'identity' THEN CAST(0.95 AS DOUBLE) WHEN 'preference' THEN CAST(0.85 AS DOUBLE) WHEN 'fact' THEN CAST(0.7 AS DOUBLE) WHEN 'negative' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END
        + CASE WHEN n_chars >= 80 THEN CAST(0.1 AS DOUBLE) WHEN n_chars >= 40 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.05 AS DOUBLE) * least(f, 3), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END, 6) AS importance FROM h
""")
def importance_score(spark, d):
    return V.memories(spark, d).select("id", r6("importance", S.importance(F.col("content"), F.col("memory_type"), F.col("pinned"))))


PROMOTED = f"(pinned OR importance * exp(CAST(-0.05 AS DOUBLE) * {V.AGE_SQL.format('created_at', now=V.NOW_SQL)}) * weight >= 0.6)"


@query(f"WITH {V.L1_SQL} SELECT session_id, CAST(sum(CASE WHEN {PROMOTED} THEN 1 ELSE 0 END) AS BIGINT) AS promoted_count, CAST(sum(CASE WHEN {PROMOTED} THEN 0 ELSE 1 END) AS BIGINT) AS dropped_count FROM l1 GROUP BY session_id")
def session_close_counts(spark, d):
    own = promotion(V.l1_items(spark, d), V.now())
    return own.groupBy("session_id").agg(F.count_if("promoted").alias("promoted_count"), F.count_if(~F.col("promoted")).alias("dropped_count"))


@query(f"WITH {V.L1_SQL} SELECT session_id, id, content, memory_type, round(importance, 6) AS importance, pinned FROM l1 WHERE {PROMOTED}")
def session_promoted(spark, d):
    """The rows that closing all sessions writes to long-term memory."""
    items = V.l1_items(spark, d)
    sessions = items.select(F.col("session_id").alias("id"), F.lit("open").alias("status"), F.lit(None).cast("timestamp").alias("closed_at")).distinct()
    promoted = close(sessions, sessions.select("id"), items, V.memories(spark, d), V.now())[1]
    return promoted.select("session_id", "id", "content", "memory_type", r6("importance"), "pinned")


@query(f"""
    WITH {V.L1_SQL}, h AS (SELECT *, len(list_filter(['api', 'redis', 'sqlite', 'postgres', 'fastapi'], lambda p: contains(lower(content), p))) AS f, length(trim(content, chr(32) || chr(9) || chr(10) || chr(13))) AS n_chars FROM l1),
    s AS (SELECT id, pinned, session_id, CASE WHEN pinned THEN greatest(importance, CAST(0.9 AS DOUBLE)) ELSE greatest(importance, least(greatest(
        CASE memory_type WHEN 'preference' THEN CAST(0.85 AS DOUBLE) WHEN 'fact' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END
        + CASE WHEN n_chars >= 80 THEN CAST(0.1 AS DOUBLE) WHEN n_chars >= 40 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.05 AS DOUBLE) * least(f, 3), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))) END AS importance FROM h)
    SELECT id AS item, round(importance, 6) AS importance, CASE WHEN pinned OR importance >= 0.6 THEN 'L2' WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN 'L1' ELSE 'none' END AS layer FROM s
""")
def remember_layers(spark, d):
    """Where a batch of remembered rows goes; odd sessions count as none."""
    rows = V.l1_items(spark, d).select(F.col("id").alias("item"), F.col("seq").alias("ord"), "content", "user_id", "tenant_id", F.expr("CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN session_id END").alias("session_id"), "memory_type", "importance", "pinned")
    return flagged(rows, V.now()).select("item", r6("importance"), "layer")


@query(f"WITH {V.L1_SQL} SELECT session_id, id, place FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY importance * weight DESC, created_at DESC, seq) AS place FROM l1) WHERE place <= 3")
def l1_evict(spark, d):
    return changes.evict(V.l1_items(spark, d), 3).where("kept").select("session_id", "id", F.col("place").cast("long").alias("place"))


SCORE = f"importance * exp(-coalesce(decay_lambda, CAST(0.001 AS DOUBLE)) * {V.AGE_SQL.format('created_at', now=V.NOW_SQL)}) * weight"


@query(f"WITH {V.MEMORIES_SQL} SELECT id, round({SCORE}, 6) AS score FROM memories WHERE deleted_at IS NULL AND NOT pinned AND {SCORE} < CAST(0.05 AS DOUBLE)")
def decay_delete_candidates(spark, d):
    return changes.decayed(V.memories(spark, d), V.now(), config=EngineConfig(decay_lambda=0.001)).select("id", r6("score"))


@query(f"WITH {V.MEMORIES_SQL} SELECT id FROM memories WHERE deleted_at IS NULL AND NOT pinned AND weight < CAST(0.12 AS DOUBLE) AND memory_type <> 'identity' AND source <> 'consolidation'")
def forget_candidates(spark, d):
    return changes.forgettable(V.memories(spark, d)).select("id")


@query(f"""
    WITH {V.MEMORIES_SQL}, w AS (SELECT id, weight, least(greatest(importance * (CAST(0.35 AS DOUBLE) + CAST(0.4 AS DOUBLE) * exp(CAST(-0.05 AS DOUBLE) * {V.AGE_SQL.format("coalesce(last_accessed_at, updated_at, created_at)", now=V.NOW_SQL)})
        + CAST(0.25 AS DOUBLE) * least(CAST(1 AS DOUBLE), ln(1 + CAST(access_count AS DOUBLE)) / ln(CAST(21 AS DOUBLE)))) * CASE WHEN pinned THEN CAST(1.35 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, CAST(0.05 AS DOUBLE)), CAST(2 AS DOUBLE)) AS nw
        FROM memories WHERE deleted_at IS NULL)
    SELECT id, round(nw, 6) AS new_weight, abs(nw - weight) >= 1e-4 AS changed FROM w
""")
def reweight(spark, d):
    return consolidate.reweighted(V.memories(spark, d), V.now()).select("id", r6("new_weight"), "changed")


@query(f"WITH {V.MEMORIES_SQL}, e AS (SELECT DISTINCT concat('m', json_extract_string(props, '$.k')) AS id FROM events) SELECT m.id, m.deleted_at IS NULL AND NOT pinned AS changed FROM memories m JOIN e USING (id)")
def soft_delete(spark, d):
    ids = V.table(spark, d, "events").select(F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("id"))
    after = changes.soft_delete(V.memories(spark, d), ids, V.now())
    return after.join(ids.distinct(), "id").select("id", "changed")


@query(f"WITH {V.MEMORIES_SQL}, e AS (SELECT concat('m', json_extract_string(props, '$.k')) AS id, count(*) AS c FROM events WHERE event_type = 'view' GROUP BY 1) SELECT id, CAST(access_count + CASE WHEN deleted_at IS NULL THEN coalesce(c, 0) ELSE 0 END AS INT) AS access_count FROM memories LEFT JOIN e USING (id)")
def access_touch(spark, d):
    used = V.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("id"))
    return changes.touch(V.memories(spark, d), used, V.now()).select("id", "access_count")


@query(f"WITH {V.MEMORIES_SQL} SELECT concat('m', e.vec_id) AS memory_id FROM embeddings e LEFT JOIN memories m ON m.n = e.vec_id AND m.deleted_at IS NULL WHERE m.id IS NULL")
def vector_dangling(spark, d):
    return migrate.dangling(V.vectors(spark, d), V.memories(spark, d)).select("memory_id")


@query(f"""
    WITH {V.MEMORIES_SQL}, m AS (SELECT *, CASE WHEN n % 10 <> 9 THEN CAST(n % 10 AS VARCHAR) END AS owner FROM memories WHERE deleted_at IS NULL),
    p AS (SELECT m.id, owner, CAST(e.label AS VARCHAR) AS v_user, CASE WHEN e.vec_id IS NOT NULL THEN 64 END AS dim FROM m LEFT JOIN embeddings e ON e.vec_id = m.n)
    SELECT id, CASE WHEN owner IS NULL THEN 'orphan_skipped' WHEN v_user IS NOT DISTINCT FROM owner AND dim IS NOT DISTINCT FROM 64 THEN 'current' ELSE 'embed' END AS action FROM p
""")
def reembed_plan(spark, d):
    rows = V.memories(spark, d).withColumn("user_id", F.expr("CASE WHEN n % 10 <> 9 THEN CAST(n % 10 AS STRING) END"))
    return migrate.plan(rows, V.vectors(spark, d), "driver", 64).select("id", "action")


@query(f"""
    WITH {V.MEMORIES_SQL}, m AS (SELECT *, CASE WHEN n % 10 <> 9 THEN CAST(n % 10 AS VARCHAR) END AS owner FROM memories WHERE deleted_at IS NULL),
    p AS (SELECT owner, CAST(e.label AS VARCHAR) AS v_user, e.vec_id IS NOT NULL AS has FROM m LEFT JOIN embeddings e ON e.vec_id = m.n)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE owner IS NOT NULL AND NOT (has AND v_user = owner)) AS reembedded, count(*) FILTER (WHERE owner IS NOT NULL AND has AND v_user = owner) AS skipped, count(*) FILTER (WHERE owner IS NULL) AS orphans_skipped,
        (SELECT count(*) FROM embeddings e LEFT JOIN m ON m.n = e.vec_id AND m.owner IS NOT NULL WHERE m.id IS NULL) AS dangling_removed FROM p
""")
def reembed_report(spark, d):
    rows = V.memories(spark, d).withColumn("user_id", F.expr("CASE WHEN n % 10 <> 9 THEN CAST(n % 10 AS STRING) END"))
    report = migrate.reembed(rows, V.vectors(spark, d), V.now(), EngineConfig(embedding_model="driver", embedding_dim=64), dry_run=True)[2]
    return report.select("scanned", "reembedded", "skipped", "orphans_skipped", "dangling_removed")


@query(f"""
    WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\s,.;:!?，。；：！？、/\\-_()（）\\[\\]{{}}]+'), lambda x: x <> '')) AS token FROM benchmark),
    c AS (SELECT item_id, token, count(*) AS n, md5(token) AS h FROM t GROUP BY item_id, token)
    SELECT item_id, CAST(CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % 64 AS INT) AS idx, round(sum(CASE WHEN CAST(concat('0x', substr(h, 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(1 + CAST(n AS DOUBLE)))), 6) AS value FROM c GROUP BY 1, 2
""")
def hash_embed_md5(spark, d):
    return hash_buckets(V.table(spark, d, "benchmark"), "item_id", "text", 64, "md5").select("item_id", "idx", r6("value"))


@query(f"WITH q AS (SELECT item_id, {V.TOKENS_SQL.format('text', 1)} AS k FROM benchmark) SELECT item_id, CAST(len(k) AS INT) AS n_tokens, CAST(len(list_distinct(k)) AS INT) AS n_distinct FROM q")
def token_counts(spark, d):
    k = tokens(F.col("text"))
    return V.table(spark, d, "benchmark").select("item_id", F.size(k).alias("n_tokens"), F.size(F.array_distinct(k)).alias("n_distinct"))


