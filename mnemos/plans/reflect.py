"""Queries about feedback, the entity graph, alerts, recommendations, consolidation and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemos.config import EngineConfig
from mnemos.functions import vocabulary as W
from mnemos.functions.text import normal_name, stacks
from mnemos.operators import alerts as A
from mnemos.operators import changes, consolidate, feedback, graph, lookup
from mnemos.operators import recall as R
from mnemos.operators.trigrams import TrigramIndex
from mnemos.plans import views as V
from mnemos.plans.memory import r6
from mnemos.sources import archive

QUERIES: dict = {}
ORACLES: dict = {}

#: Words that the driver's texts have: topics of consolidation and stacks for them.
TOPICS = {"database": ("the the", "tion"), "backend_lang": ("que", "ment"), "auth": ("ich", "und")}
STACKS = {"java": ("thand", "ingon"), "go": ("go",), "python": ("erha", "tion"), "rust": ("que", "ment"), "php": ("ung",)}
DATABASES = {"mysql": ("erha",), "sqlite": ("ingon",), "mongodb": ("thand", "enti")}
LANGUAGES = {"java": ("ement",), "rust": ("eux",), "python": ("ungen",)}
NEGATION = "tion|ich"
CONFIG = EngineConfig(decay_lambda=0.001, topics=TOPICS, stacks=STACKS, alert_similarity=0.2, recommend_min_score=0.2, databases=DATABASES, languages=LANGUAGES, conflict_negation=NEGATION)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def names_of(text: str, groups) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(text, ws)}" + (f" AND (NOT contains(lower({text}), 'go') OR regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])go($|[^\\p{{L}}\\p{{N}}_])|golang'))" if k == "go" else "") + f" THEN '{k}' END" for k, ws in groups.items()) + "], lambda x: x IS NOT NULL)"


# --- feedback


@query(f"""
    WITH {V.FEEDBACK_SQL} SELECT id, CASE WHEN feedback_type = 'correct' AND (correction_text IS NULL OR trim(correction_text) = '') THEN 'correction text is missing' END AS problem FROM feedback
""")
def feedback_validation(spark, d):
    return feedback.validated(V.feedback(spark, d)).select("id", "problem")


@query(f"""
    WITH {V.FEEDBACK_SQL}, {V.MEMORIES_SQL}, s AS (SELECT memory_id, feedback_type = 'upvote' AS up, count(*) AS n FROM feedback GROUP BY 1, 2)
    SELECT m.id, s.up, round(CASE WHEN m.deleted_at IS NOT NULL THEN m.weight WHEN s.up THEN least(greatest(m.weight + CAST(0.05 AS DOUBLE) * s.n, CAST(0.05 AS DOUBLE)), CAST(3 AS DOUBLE)) ELSE least(greatest(m.weight - CAST(0.1 AS DOUBLE) * s.n, CAST(0.05 AS DOUBLE)), CAST(3 AS DOUBLE)) END, 6) AS weight
    FROM s JOIN memories m ON m.id = s.memory_id
""")
def feedback_weights(spark, d):
    """Praise and objections apart: deltas of one sign have a closed form, which the oracle uses."""
    deltas = feedback.weight_deltas(V.feedback(spark, d))
    m = V.memories(spark, d)
    parts = []
    for up in (True, False):
        own = deltas.where("delta > 0" if up else "delta < 0")
        parts.append(changes.adjust_weights(m, own).join(own.select("id").distinct(), "id", "left_semi").select("id", F.lit(up).alias("up"), r6("weight")))
    return parts[0].unionByName(parts[1])


@query(f"""
    WITH {V.FEEDBACK_SQL}, {V.MEMORIES_SQL}, s AS (SELECT memory_id, list(CASE WHEN feedback_type = 'upvote' THEN CAST(0.05 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END ORDER BY created_at, id) AS deltas FROM feedback GROUP BY 1)
    SELECT m.id, round(CASE WHEN deltas IS NULL OR deleted_at IS NOT NULL THEN weight ELSE list_reduce(list_prepend(weight, deltas), lambda w, x: least(greatest(w + x, CAST(0.05 AS DOUBLE)), CAST(3 AS DOUBLE))) END, 6) AS weight
    FROM memories m LEFT JOIN s ON s.memory_id = m.id
""")
def feedback_weights_mixed(spark, d):
    """Weights after all events in order, each step clamped."""
    m = V.memories(spark, d)
    deltas = feedback.weight_deltas(V.feedback(spark, d))
    return changes.adjust_weights(m, deltas).select("id", r6("weight"))


def _related_sql() -> str:
    return f"{V.FEEDBACK_SQL}, {V.MEMORIES_SQL}, f AS (SELECT f.*, m.content AS related FROM feedback f LEFT JOIN memories m ON m.id = f.memory_id AND m.deleted_at IS NULL), t AS (SELECT *, coalesce(trim(correction_text), '') AS c FROM f WHERE feedback_type <> 'upvote')"


DRAFT = f"""
    WITH {_related_sql()}, dr AS (SELECT id, feedback_type,
        CASE WHEN feedback_type = 'correct' AND length(c) < 2 THEN '' WHEN feedback_type = 'correct' THEN concat(c, '。')
             WHEN c <> '' THEN concat('{W.DOWNVOTED[0]}', c) WHEN related IS NOT NULL THEN concat('{W.DOWNVOTED[1]}', related[1:80]) WHEN answer_text IS NOT NULL THEN concat('{W.DOWNVOTED[2]}', answer_text[1:160]) ELSE '{W.DOWNVOTED[3]}' END AS summary,
        CASE WHEN feedback_type = 'correct' AND length(c) < 2 THEN CAST(0.2 AS DOUBLE) WHEN feedback_type = 'correct' AND length(c) >= 6 THEN CAST(0.9 AS DOUBLE) WHEN feedback_type = 'correct' THEN CAST(0.75 AS DOUBLE)
             WHEN c <> '' THEN CAST(0.8 AS DOUBLE) WHEN related IS NOT NULL THEN CAST(0.72 AS DOUBLE) WHEN answer_text IS NOT NULL THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END AS confidence,
        CASE WHEN feedback_type = 'correct' AND length(c) < 2 THEN 'reflection' WHEN feedback_type = 'correct' THEN 'fact' ELSE 'negative' END AS memory_type FROM t)
"""


def _drafted(spark, d):
    return feedback.drafts(feedback.with_related(V.feedback(spark, d).where("feedback_type <> 'upvote'"), V.memories(spark, d)))


@query(DRAFT + "SELECT id, summary, confidence, memory_type FROM dr")
def reflection_drafts(spark, d):
    return _drafted(spark, d).select("id", F.col("draft.summary").alias("summary"), F.col("draft.confidence").alias("confidence"), F.col("draft.memory_type").alias("memory_type"))


@query(DRAFT + "SELECT id, CASE WHEN confidence < 0.7 OR summary = '' THEN 'rejected_low_confidence' ELSE 'accepted' END AS status, NOT (confidence < 0.7 OR summary = '') AS writes FROM dr")
def reflection_status(spark, d):
    return feedback.finalise(_drafted(spark, d)).select("id", "status", "writes")


# --- graph


EXTRACT = f"""
    WITH {V.SENTENCES_SQL}, e AS (
        SELECT id, 'depends_on' AS relation_type, CAST(0.85 AS DOUBLE) AS confidence, regexp_extract(text, '(?i)([^\\s，。；、]+?)\\s*(?:depends\\s+on)\\s*([^。；;\\n]+)', 1) AS from_name, regexp_extract(text, '(?i)([^\\s，。；、]+?)\\s*(?:depends\\s+on)\\s*([^。；;\\n]+)', 2) AS blob FROM sentences
        UNION ALL SELECT id, 'uses', CAST(0.75 AS DOUBLE), regexp_extract(text, '(?i)([^\\s，。；、]+?)\\s*(?:uses)\\s*([^。；;\\n]+)', 1), regexp_extract(text, '(?i)([^\\s，。；、]+?)\\s*(?:uses)\\s*([^。；;\\n]+)', 2) FROM sentences),
    r AS (SELECT id, relation_type, confidence, from_name, trim(unnest(regexp_split_to_array(blob, '[、,，/]|和|与|及|以及|\\band\\b'))) AS to_name FROM e WHERE blob <> ''),
    k AS (SELECT *, CASE WHEN contains(lower(to_name), 'redis') THEN 'tech' ELSE 'other' END AS to_type FROM r WHERE to_name <> '')
"""


@query(EXTRACT + "SELECT id, from_name, to_name, relation_type, confidence, to_type FROM k")
def graph_extract_relations(spark, d):
    return graph.extract_relations(V.sentences(spark, d)).select("id", "from_name", "to_name", "relation_type", "confidence", "to_type")


@query(EXTRACT + "SELECT DISTINCT id, name, entity_type FROM (SELECT id, from_name AS name, 'other' AS entity_type FROM k UNION ALL SELECT id, to_name, to_type FROM k)")
def graph_extract_entities(spark, d):
    return graph.extract_entities(graph.extract_relations(V.sentences(spark, d))).select("id", "name", "entity_type")


@query(EXTRACT + f"""
    , {V.GRAPH_SQL}, f AS (SELECT regexp_replace(lower(name), '\\s+', '', 'g') AS norm, arg_max(entity_type, id) AS kind FROM (SELECT id, from_name AS name, 'other' AS entity_type FROM k UNION ALL SELECT id, to_name, to_type FROM k) GROUP BY 1),
    b AS (SELECT *, regexp_replace(lower(name), '\\s+', '', 'g') AS norm FROM entities)
    SELECT b.id, b.norm AS low, coalesce(f.kind, b.entity_type) AS entity_type FROM b LEFT JOIN f USING (norm) UNION ALL SELECT 'new', norm, kind FROM f WHERE norm NOT IN (SELECT norm FROM b)
""")
def entity_upsert(spark, d):
    """Extracted entities onto the graph's: suppliers and nations are known, parts and brands are new."""
    found = graph.extract_entities(graph.extract_relations(V.sentences(spark, d)))
    rows = found.select(F.lit("u").alias("user_id"), F.lit(None).cast("string").alias("tenant_id"), "name", "entity_type", F.array().cast("array<string>").alias("aliases"), F.col("id").alias("ord"))
    out = graph.upsert_entities(V.entities(spark, d), rows, V.now())
    return out.select(F.when(F.col("id").startswith("ent_"), "new").otherwise(F.col("id")).alias("id"), normal_name(F.col("name")).alias("low"), "entity_type")


_ORD = "(l_orderkey * 10 + l_linenumber) * 1000 + CAST(round(l_discount * 100) AS BIGINT)"


@query(f"""
    SELECT concat('p', l_partkey) AS a, concat('s', l_suppkey) AS b, max(l_quantity) AS confidence,
        coalesce(arg_max(l_discount, {_ORD}) FILTER (l_returnflag <> 'R'), arg_max(l_discount, {_ORD}) FILTER (l_returnflag = 'R')) AS weight FROM lineitem GROUP BY 1, 2
""")
def relation_upsert(spark, d):
    """Returned lines make the relations that all other lines then update or add to."""
    li = V.table(spark, d, "lineitem")
    found = li.select(
        F.lit("u").alias("user_id"), F.lit(None).cast("string").alias("tenant_id"), F.concat(F.lit("p"), "l_partkey").alias("from_entity_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_entity_id"), F.lit("uses").alias("relation_type"),
        F.col("l_discount").alias("weight"), F.col("l_quantity").alias("confidence"), F.lit("").alias("source_memory_id"), F.expr(_ORD).alias("ord"), (F.col("l_returnflag") == "R").alias("first"),
    )
    base = graph.upsert_relations(V.relations(spark, d).where("false"), found.where("first").drop("first"), V.now())
    out = graph.upsert_relations(base, found.where("NOT first").drop("first"), V.now())
    return out.select(F.col("from_entity_id").alias("a"), F.col("to_entity_id").alias("b"), "confidence", "weight")


@query(f"WITH {V.GRAPH_SQL}, q AS (SELECT DISTINCT concat(' nation_', substr(n_name, 8), ' ') AS name FROM nation), n AS (SELECT regexp_replace(lower(name), '\\s+', '', 'g') AS norm, min(id) AS entity_id FROM entities GROUP BY 1) SELECT name, entity_id FROM q LEFT JOIN n ON norm = regexp_replace(lower(q.name), '\\s+', '', 'g')")
def entity_resolution(spark, d):
    q = V.table(spark, d, "nation").select(F.lit("u").alias("user_id"), F.concat(F.lit(" nation_"), F.expr("substr(n_name, 8)"), F.lit(" ")).alias("name")).distinct()
    return lookup.resolve(q, V.entities(spark, d)).select("name", "entity_id")


@query(f"WITH {V.GRAPH_SQL} SELECT id, name FROM entities WHERE contains(regexp_replace(lower(name), '\\s+', '', 'g'), 'nation_1') ORDER BY id LIMIT 50")
def entity_search(spark, d):
    return lookup.search_entities(V.entities(spark, d), user_id="u", q="Nation _1", limit=50).select("id", "name")


@query(f"""
    WITH {V.GRAPH_SQL}, q AS (SELECT concat('Nation _', n_nationkey) AS q, CAST(n_nationkey AS BIGINT) AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN 'project' END AS kind FROM nation UNION ALL SELECT concat('0', r_regionkey), 100 + r_regionkey, NULL FROM region UNION ALL SELECT '#', 200, NULL)
    SELECT request_id, id FROM q JOIN entities ON contains(regexp_replace(lower(name), '\\s+', '', 'g'), regexp_replace(lower(q), '\\s+', '', 'g')) WHERE kind IS NULL OR entity_type = kind
""")
def entity_search_indexed(spark, d):
    """Substring searches for every nation's and region's number, and for a single character, through an index of trigrams."""
    e = V.entities(spark, d)
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"), F.concat(F.lit("Nation _"), "n_nationkey").alias("q"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'project' END").alias("entity_type"))
    r = V.table(spark, d, "region").select((100 + F.col("r_regionkey")).cast("long").alias("request_id"), F.concat(F.lit("0"), "r_regionkey").alias("q"), F.lit(None).cast("string").alias("entity_type"))
    one = spark.createDataFrame([(200, "#", None)], r.schema)
    asked = n.unionByName(r).unionByName(one).withColumn("user_id", F.lit("u")).withColumn("tenant_id", F.lit(None).cast("string"))
    index = TrigramIndex.build(e, "id", normal_name(F.col("name")))
    return lookup.search_entities_indexed(e, index, asked).select("request_id", "id")


def impact_sql(edges: str, hops: int, seeds: str) -> str:
    return f"""
    WITH RECURSIVE {V.GRAPH_SQL}, steps AS (SELECT DISTINCT src, dst, edge FROM ({edges})), p AS (
        SELECT id AS seed_id, id AS at, [id] AS nodes, CAST([] AS VARCHAR[]) AS edges, 0 AS hops FROM entities WHERE {seeds}
        UNION ALL SELECT p.seed_id, s.dst, list_append(p.nodes, s.dst), list_append(p.edges, s.edge), p.hops + 1 FROM p JOIN steps s ON s.src = p.at WHERE p.hops < {hops} AND NOT list_contains(p.nodes, s.dst))
    SELECT p.seed_id, CAST(p.hops AS INT) AS hops, e.name AS end_name, array_to_string(p.nodes, ' ') AS path, array_to_string(p.edges, ' ') AS edges FROM p JOIN entities e ON e.id = p.at WHERE p.hops > 0
    """


FORTH, BACK = "SELECT a AS src, b AS dst, concat(a, '>', b) AS edge FROM relations", "SELECT b AS src, a AS dst, concat(a, '>', b) AS edge FROM relations"


def _impact(spark, d, direction, hops, *prefixes):
    e, r = V.entities(spark, d), V.relations(spark, d)
    seeds = e.where(F.substring("id", 1, 1).isin(*prefixes)).select(F.col("id").alias("seed_id"), "user_id", F.col("id").alias("entity_id"))
    out = graph.impact(seeds, e, r, direction, hops)
    ids = lambda c: F.array_join(f"{c}.id", " ").alias("path" if c == "nodes" else c)
    return out.select("seed_id", "hops", "end_name", ids("nodes"), ids("edges"))


@query(impact_sql(BACK, 2, "starts_with(id, 'r')"))
def impact_inbound(spark, d):
    return _impact(spark, d, "inbound", 2, "r")


@query(impact_sql(FORTH, 3, "starts_with(id, 's')"))
def impact_outbound(spark, d):
    return _impact(spark, d, "outbound", 3, "s")


@query(impact_sql(f"{FORTH} UNION ALL {BACK}", 2, "starts_with(id, 'r') OR starts_with(id, 's')"))
def impact_both(spark, d):
    return _impact(spark, d, "both", 2, "r", "s")


@query(f"""
    WITH a AS ({impact_sql(f"{FORTH} UNION ALL {BACK}", 5, "starts_with(id, 'n')")}),
    b AS (SELECT seed_id, hops, end_name, path, row_number() OVER (PARTITION BY seed_id ORDER BY hops, end_name, sha256(concat(seed_id, chr(31), replace(path, ' ', chr(31))))) AS rank FROM a)
    SELECT * FROM b WHERE rank <= 200
""")
def impact_ranked(spark, d):
    """Paths of five hops at most in both directions from every nation, the first 200 of each in their order."""
    e, r = V.entities(spark, d), V.relations(spark, d)
    seeds = e.where(F.col("id").startswith("n")).select(F.col("id").alias("seed_id"), "user_id", F.col("id").alias("entity_id"))
    out = graph.ranked(graph.impact(seeds, e, r, "both", 5)).where("rank <= 200")
    return out.select("seed_id", "hops", "end_name", F.array_join("nodes.id", " ").alias("path"), F.col("rank").cast("long").alias("rank"))


# --- alerts and recommendations


@query(f"SELECT doc_id, array_to_string({names_of('text', STACKS)}, ',') AS stacks FROM documents")
def stack_detection(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(stacks(F.col("text"), STACKS), ",").alias("stacks"))


def alerts_sql(kind: str) -> str:
    return f"""
    WITH {V.EMBEDDED_SQL}, {V.QUERIES_SQL}, vec AS (SELECT concat('m', vec_id) AS id, CAST(label AS VARCHAR) AS user_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    hits AS (SELECT * FROM (SELECT q.query_id, v.id, list_cosine_similarity(q.vector, v.v) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.vector, v.v) DESC, v.id) AS place FROM queries q JOIN vec v USING (user_id)) WHERE place <= 8),
    near AS (SELECT h.*, m.content AS old, q.query AS new, {names_of('m.content', STACKS)} AS os, {names_of('q.query', STACKS)} AS ns,
        list_distinct({V.TOKENS_SQL.format('m.content', 2)}) AS ko, list_distinct({V.TOKENS_SQL.format('q.query', 2)}) AS kn
        FROM hits h JOIN embedded m USING (id) JOIN queries q USING (query_id) WHERE m.deleted_at IS NULL AND sim >= CAST(0.2 AS DOUBLE)),
    s AS (SELECT *, list_min(list_filter(os, lambda x: NOT list_contains(ns, x))) AS gone, list_min(list_filter(ns, lambda x: NOT list_contains(os, x))) AS added,
        trim(old) = trim(new) OR (CAST(len(list_filter(kn, lambda x: contains(lower(old), x))) AS DOUBLE) / len(kn) >= 0.72 AND CAST(len(list_filter(ko, lambda x: contains(lower(new), x))) AS DOUBLE) / len(ko) >= 0.72) AS dup FROM near),
    k AS (SELECT *, CASE WHEN gone IS NOT NULL AND added IS NOT NULL THEN 'tech_stack_shift' WHEN sim >= CAST(0.2 AS DOUBLE) + CAST(0.08 AS DOUBLE) AND NOT dup AND len(os) > 0 AND len(ns) > 0 AND NOT list_has_any(os, ns) THEN 'conflict' END AS type FROM s),
    m AS (SELECT query_id, id, type, place, CASE WHEN type = 'conflict' THEN least(CAST(1 AS DOUBLE), sim) ELSE least(CAST(1 AS DOUBLE), CAST(0.55 AS DOUBLE) + CAST(0.45 AS DOUBLE) * sim) END AS severity,
        CASE WHEN type = 'conflict' THEN concat('{W.CONFLICT_MESSAGE[0]}', old[1:48], '{W.CONFLICT_MESSAGE[1]}') ELSE concat('{W.SHIFT_MESSAGE[0]}', gone, '{W.SHIFT_MESSAGE[1]}', added, '{W.SHIFT_MESSAGE[2]}', old[1:48], '{W.SHIFT_MESSAGE[3]}') END AS message FROM k WHERE type IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, type, message[1:80] ORDER BY severity DESC, place, id) AS n FROM m),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY severity DESC, place, id) AS rank FROM o WHERE n = 1)
    SELECT query_id, type, round(severity, 6) AS severity, message, id AS memory_id, rank FROM t WHERE rank <= 3
    """


@query(alerts_sql("all"))
def stack_shift_alerts(spark, d):
    c = V.queries(spark, d).withColumnRenamed("query", "content")
    return A.detect(c, V.embedded(spark, d), V.vectors(spark, d), CONFIG).select("query_id", "type", r6("severity"), "message", "memory_id", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH {V.EMBEDDED_SQL}, {V.QUERIES_SQL}, vec AS (SELECT concat('m', vec_id) AS id, CAST(label AS VARCHAR) AS user_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    hits AS (SELECT * FROM (SELECT q.query_id, v.id, list_cosine_similarity(q.vector, v.v) AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.vector, v.v) DESC, v.id) AS place FROM queries q JOIN vec v USING (user_id)) WHERE place <= 10),
    recent AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM embedded m WHERE deleted_at IS NULL) WHERE place <= 40),
    sides AS (SELECT h.query_id, m.id, m.content, h.sim, h.place, 1 AS tier FROM hits h JOIN embedded m USING (id) WHERE m.deleted_at IS NULL
        UNION ALL SELECT q.query_id, r.id, r.content, CAST(0 AS DOUBLE), r.place, 2 FROM recent r JOIN queries q USING (user_id)),
    k AS (SELECT s.*, list_distinct({V.TOKENS_SQL.format("q.query", 2)}) AS keys FROM sides s JOIN queries q USING (query_id)),
    sc AS (SELECT *, greatest(CAST(0 AS DOUBLE), sim, CAST(len(list_filter(keys, lambda x: contains(lower(content), x))) AS DOUBLE) / len(keys)) AS score FROM k),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY tier) AS n FROM sc WHERE score >= CAST(0.2 AS DOUBLE)),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN CAST(place AS DOUBLE) ELSE -score END, place, id) AS rank FROM o WHERE n = 1)
    SELECT query_id, id AS memory_id, round(score, 6) AS score, tier, rank FROM t WHERE rank <= 3
""")
def recommend_sidecar(spark, d):
    out = R.recommend(V.queries(spark, d), V.embedded(spark, d), V.vectors(spark, d), CONFIG)
    return out.select("query_id", "memory_id", r6("score"), "tier", F.col("rank").cast("long").alias("rank"))


# --- consolidation


@query(f"""
    WITH {V.MEMORIES_SQL}, r AS (SELECT *, unnest({names_of('content', TOPICS)}) AS topic FROM memories WHERE deleted_at IS NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY pinned DESC, source = 'reflection' DESC, weight DESC, updated_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY user_id, topic) AS members FROM r)
    SELECT user_id, topic, id AS winner, members FROM w WHERE k = 1 AND members > 1
""")
def conflict_winners(spark, d):
    rows = lookup.active(V.memories(spark, d)).withColumn("topic", F.explode(consolidate.matching(F.col("content"), TOPICS)))
    rank = F.struct("pinned", (F.col("source") == "reflection").alias("r"), "weight", "updated_at", "id")
    return rows.groupBy("user_id", "topic").agg(F.max(rank)["id"].alias("winner"), F.count("*").alias("members")).where("members > 1")


def _spoken(text: str) -> str:
    return f"list_sort(list_distinct(list_concat({names_of(text, LANGUAGES)}, CASE WHEN regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])go($|[^\\p{{L}}\\p{{N}}_])') THEN ['golang'] ELSE CAST([] AS VARCHAR[]) END)))"


def _apart(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND {a} <> {b})"


@query(f"""
    WITH {V.MEMORIES_SQL}, r AS (SELECT *, unnest({names_of('content', TOPICS)}) AS topic FROM memories WHERE deleted_at IS NULL),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY pinned DESC, source = 'reflection' DESC, weight DESC, updated_at DESC, id DESC) AS place FROM r),
    m AS (SELECT l.user_id, l.topic, w.id AS winner, l.id AS loser, w.content AS a, l.content AS b FROM w JOIN w l ON w.user_id IS NOT DISTINCT FROM l.user_id AND w.topic = l.topic WHERE w.place = 1 AND l.place > 1 AND NOT l.pinned),
    n AS (SELECT *, {names_of('a', DATABASES)} AS da, {names_of('b', DATABASES)} AS db, {_spoken('a')} AS la, {_spoken('b')} AS lb, list_distinct({V.TOKENS_SQL.format('a', 2)}) AS ka, list_distinct({V.TOKENS_SQL.format('b', 2)}) AS kb FROM m)
    SELECT user_id, topic, winner, loser FROM n WHERE CASE topic WHEN 'database' THEN {_apart('da', 'db')} WHEN 'backend_lang' THEN {_apart('la', 'lb')}
        ELSE regexp_matches(concat(lower(a), lower(b)), '{NEGATION}') AND len(ka) > 0 AND len(kb) > 0 AND CAST(len(list_intersect(ka, kb)) AS DOUBLE) / len(list_distinct(list_concat(ka, kb))) >= 0.25 END
""")
def conflict_losers(spark, d):
    """What consolidation retires in each topic."""
    return consolidate.conflicts(V.memories(spark, d), CONFIG).select("user_id", "topic", "winner", "loser")


TOPIC_ROWS = f"""
    WITH {V.MEMORIES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM memories WHERE deleted_at IS NULL AND NOT pinned AND memory_type IN ('fact', 'episode')),
    h AS (SELECT *, {any_of("content", TOPICS["database"])} AS h1, {any_of("content", TOPICS["backend_lang"])} AS h2, {any_of("content", TOPICS["auth"])} AS h3 FROM c),
    a AS (SELECT *, h1 AND sum(CASE WHEN h1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) >= 3 AS t1 FROM h),
    b AS (SELECT *, NOT t1 AND h2 AND sum(CASE WHEN NOT t1 AND h2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) >= 3 AS t2 FROM a),
    e AS (SELECT *, NOT t1 AND NOT t2 AND h3 AND sum(CASE WHEN NOT t1 AND NOT t2 AND h3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) >= 3 AS t3 FROM b),
    t AS (SELECT *, CASE WHEN t1 THEN 'database' WHEN t2 THEN 'backend_lang' WHEN t3 THEN 'auth' END AS topic FROM e)
"""


@query(TOPIC_ROWS + "SELECT id, topic FROM t")
def topic_buckets(spark, d):
    return consolidate.topic_clusters(consolidate.candidates(V.memories(spark, d)), CONFIG).select("id", "topic")


@query(TOPIC_ROWS + f"""
    , f AS (SELECT user_id, topic, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS text, length(content) AS n, place, regexp_replace(lower(content), '\\s+', '', 'g')[1:48] AS key, importance, weight FROM t WHERE topic IS NOT NULL),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic, key ORDER BY n DESC, place) AS k FROM f),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY n DESC, place) AS r FROM g WHERE k = 1),
    s AS (SELECT user_id, topic, string_agg(text, '{W.FRAGMENT_JOIN}' ORDER BY r) AS fragments FROM i WHERE r <= 4 GROUP BY 1, 2),
    m AS (SELECT user_id, topic, count(*) AS members, round(max(importance), 6) AS importance, round(max(weight), 6) AS weight,
        bool_or({any_of("text", TOPICS["database"])}) AS g1, bool_or({any_of("text", TOPICS["backend_lang"])}) AS g2 FROM f GROUP BY 1, 2)
    SELECT user_id, concat('t:', topic) AS cluster, concat('【精华摘要·', CASE WHEN g1 THEN 'database' WHEN g2 THEN 'backend_lang' ELSE topic END, '】', fragments) AS summary, members, importance, weight FROM m JOIN s USING (user_id, topic)
""")
def summaries(spark, d):
    rows = consolidate.topic_clusters(consolidate.candidates(V.memories(spark, d)), CONFIG).where("topic IS NOT NULL").withColumn("cluster", F.concat(F.lit("t:"), "topic"))
    return consolidate.summaries(rows, CONFIG).select("user_id", "cluster", "summary", "members", r6("importance"), r6("weight"))


@query(f"""
    WITH RECURSIVE {V.EMBEDDED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM embedded WHERE deleted_at IS NULL AND NOT pinned AND memory_type IN ('fact', 'episode')),
    k AS (SELECT user_id, id, place, vector, list_distinct({V.TOKENS_SQL.format('content', 2)}) AS ks, {names_of('content', EngineConfig().topics)} AS topics FROM c),
    pairs AS (SELECT a.user_id, a.place AS head, b.place FROM k a JOIN k b ON a.user_id = b.user_id AND a.place < b.place
        WHERE list_cosine_similarity(a.vector, b.vector) >= 0.3 OR (len(a.ks) > 0 AND len(b.ks) > 0 AND CAST(len(list_intersect(a.ks, b.ks)) AS DOUBLE) / len(list_distinct(list_concat(a.ks, b.ks))) >= 0.12)),
    near AS (SELECT user_id, head, list(place) AS places FROM pairs GROUP BY 1, 2),
    s AS (SELECT DISTINCT user_id, 0 AS n, CAST(0 AS BIGINT) AS head, CAST([] AS BIGINT[]) AS star, CAST([] AS BIGINT[]) AS used FROM k
        UNION ALL SELECT user_id, n + 1, h, list_concat([h], star), list_concat(used, [h], star) FROM (
            SELECT s.user_id, s.n, near.head AS h, list_filter(near.places, lambda x: NOT list_contains(s.used, x)) AS star, s.used, row_number() OVER (PARTITION BY s.user_id ORDER BY near.head) AS r
            FROM s JOIN near ON near.user_id = s.user_id WHERE near.head > s.head AND NOT list_contains(s.used, near.head) AND s.n < 20 AND len(list_filter(near.places, lambda x: NOT list_contains(s.used, x))) >= 2) WHERE r = 1),
    m AS (SELECT user_id, head, unnest(star) AS place FROM s WHERE n > 0)
    SELECT k.user_id, k.id, concat('s:', lpad(CAST(m.head AS VARCHAR), 12, '0')) AS cluster FROM m JOIN k ON k.user_id = m.user_id AND k.place = m.place WHERE len(k.topics) = 0
""")
def cluster_compress(spark, d):
    """Stars of what may be compressed; the driver's texts have none of the topics' words."""
    return consolidate.clusters(V.embedded(spark, d), V.vectors(spark, d), EngineConfig(cluster_similarity=0.3)).select("user_id", "id", "cluster")


# --- archive


@query(f"WITH {V.MEMORIES_SQL}, {V.GRAPH_SQL} SELECT 'memories' AS section, count(*) AS n FROM memories WHERE deleted_at IS NULL UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations")
def archive_counts(spark, d):
    return archive.counts(archive.sections(V.memories(spark, d), V.entities(spark, d), V.relations(spark, d)))


@query("SELECT concat('l3_', o_orderkey) AS id FROM orders ORDER BY o_orderdate DESC, concat('l3_', o_orderkey) LIMIT 20")
def archive_latest(spark, d):
    rows = V.table(spark, d, "orders").select(F.concat(F.lit("l3_"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return archive.latest(rows).select("id")
