"""The driver's tables as the engine's tables, once as DataFrames and once as SQL for DuckDB.

Columns that the driver's tables don't have are functions of ids; the expressions are the same text in both engines but for
the times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2026-01-01 00:00:00"

MEMORY = {
    "id": "concat('m', doc_id)",
    "n": "doc_id",
    "user_id": "source",
    "tenant_id": "lang",
    "content": "text",
    "memory_type": "CASE doc_id % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'preference' WHEN 2 THEN 'fact' WHEN 3 THEN 'episode' ELSE 'negative' END",
    "importance": "CAST(0.3 AS DOUBLE) + CAST(doc_id % 7 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "weight": "CAST(0.05 AS DOUBLE) + CAST(doc_id % 13 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "pinned": "doc_id % 11 = 0",
    "source": "CASE WHEN doc_id % 9 = 0 THEN 'reflection' ELSE 'ingest' END",
    "decay_lambda": "CASE WHEN doc_id % 6 = 0 THEN CAST(0.01 AS DOUBLE) END",
    "access_count": "CAST(doc_id % 23 AS INT)",
}
HOURS = {"created_at": "doc_id", "updated_at": "doc_id + doc_id % 48", "last_accessed_at": "CASE WHEN doc_id % 3 > 0 THEN doc_id + doc_id % 48 + 1 END", "deleted_at": "CASE WHEN doc_id % 17 = 3 THEN doc_id + doc_id % 48 END"}

_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in MEMORY.items())
MEMORIES_SQL = f"memories AS (SELECT {_COLUMNS}, " + ", ".join(f"TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({e} AS BIGINT)) AS {c}" for c, e in HOURS.items()) + " FROM documents)"
#: Documents that have a vector; the vector's label is the user.
EMBEDDED_SQL = MEMORIES_SQL + ", embedded AS (SELECT m.* EXCLUDE (user_id), CAST(e.label AS VARCHAR) AS user_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM memories m JOIN embeddings e ON m.n = e.vec_id)"
#: Every fiftieth vector asks, with the words of a benchmark item.
QUERIES_SQL = (
    "queries AS (SELECT e.vec_id AS query_id, CAST(e.label AS VARCHAR) AS user_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vector, b.text AS query FROM embeddings e "
    "JOIN benchmark b ON b.item_id = e.vec_id // 50 WHERE e.vec_id % 50 = 0)"
)
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[\\s,.;:!?，。；：！？、]+'), lambda t: length(t) >= {1})"
NOW_SQL = f"TIMESTAMP '{NOW}'"
AGE_SQL = "greatest((epoch_us({now}) - epoch_us({0})) / CAST(86400000000 AS DOUBLE), CAST(0 AS DOUBLE))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hours = [F.expr(f"timestamp_micros(unix_micros(TIMESTAMP '2024-01-01 00:00:00') + CAST({e} AS BIGINT) * 3600000000)").alias(c) for c, e in HOURS.items()]
    return docs.select(*[F.expr(e).alias(c) for c, e in MEMORY.items()], *hours)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id")).alias("memory_id"), F.col("label").cast("string").alias("user_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("n"), F.lit("driver").alias("model"), F.size("embedding").alias("dim"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("label").cast("string").alias("user_id"))
    return memories(spark, sf_dir).drop("user_id").join(own, "n")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("user_id"), F.col("embedding").alias("vector"), F.expr("vec_id DIV 50").alias("item_id"))
    return e.join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query")), "item_id").drop("item_id")


def l1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = "CASE role WHEN 'user' THEN 'fact' WHEN 'assistant' THEN 'episode' ELSE 'preference' END"
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("content"),
        F.expr(kind).alias("memory_type"), F.expr("CAST(0.2 AS DOUBLE) + CAST(turn % 8 AS DOUBLE) / CAST(10 AS DOUBLE)").alias("importance"), F.lit(1.0).alias("weight"), F.expr("turn % 7 = 6").alias("pinned"),
        F.expr("concat('u', conv_id % 5)").alias("user_id"), F.lit(None).cast("string").alias("tenant_id"),
        F.expr("timestamp_micros(unix_micros(TIMESTAMP '2025-12-25 00:00:00') + CAST(turn AS BIGINT) * 3600000000)").alias("created_at"),
    )


L1_SQL = (
    "l1 AS (SELECT concat('c', conv_id, '-', turn) AS id, CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, text AS content, "
    "CASE role WHEN 'user' THEN 'fact' WHEN 'assistant' THEN 'episode' ELSE 'preference' END AS memory_type, CAST(0.2 AS DOUBLE) + CAST(turn % 8 AS DOUBLE) / CAST(10 AS DOUBLE) AS importance, "
    "CAST(1 AS DOUBLE) AS weight, turn % 7 = 6 AS pinned, concat('u', conv_id % 5) AS user_id, TIMESTAMP '2025-12-25 00:00:00' + to_hours(turn) AS created_at FROM conversations)"
)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as entities of one user."""
    of = lambda name, prefix, key, title, kind: table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.col(title).alias("name"), F.lit(kind).alias("entity_type"))
    rows = of("region", "r", "r_regionkey", "r_name", "other").unionByName(of("nation", "n", "n_nationkey", "n_name", "project")).unionByName(of("supplier", "s", "s_suppkey", "s_name", "service")).unionByName(of("customer", "c", "c_custkey", "c_name", "person"))
    return rows.select("id", F.lit(None).cast("string").alias("tenant_id"), F.lit("u").alias("user_id"), "name", "entity_type", F.array().cast("array<string>").alias("aliases"), F.lit("{}").alias("meta_json"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation owned_by region, supplier and customer depend on their nation."""
    of = lambda name, a, ka, b, kb, kind: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(ka)).alias("from_entity_id"), F.concat(F.lit(b), F.col(kb)).alias("to_entity_id"), F.lit(kind).alias("relation_type"))
    rows = of("nation", "n", "n_nationkey", "r", "n_regionkey", "owned_by").unionByName(of("supplier", "s", "s_suppkey", "n", "s_nationkey", "depends_on")).unionByName(of("customer", "c", "c_custkey", "n", "c_nationkey", "depends_on"))
    return rows.select(F.concat_ws(">", "from_entity_id", "to_entity_id").alias("id"), F.lit(None).cast("string").alias("tenant_id"), F.lit("u").alias("user_id"), "from_entity_id", "to_entity_id", "relation_type", F.lit(1.0).alias("weight"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("source_memory_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))


GRAPH_SQL = (
    "entities AS (SELECT concat('r', r_regionkey) AS id, r_name AS name, 'other' AS entity_type FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, 'project' FROM nation "
    "UNION ALL SELECT concat('s', s_suppkey), s_name, 'service' FROM supplier UNION ALL SELECT concat('c', c_custkey), c_name, 'person' FROM customer), "
    "relations AS (SELECT concat('n', n_nationkey) AS a, concat('r', n_regionkey) AS b, 'owned_by' AS kind FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'depends_on' FROM supplier "
    "UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'depends_on' FROM customer)"
)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback on the memory that their props name; purchases praise, errors and clicks object."""
    e = table(spark, sf_dir, "events")
    kind = "CASE event_type WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' WHEN 'click' THEN 'correct' END"
    return e.where("event_type IN ('purchase', 'error', 'click')").select(
        F.concat(F.lit("fb"), F.col("event_id")).alias("id"), F.col("event_id").alias("n"), F.lit(None).cast("string").alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.lit(None).cast("string").alias("session_id"),
        F.concat(F.lit("a"), F.col("event_id")).alias("answer_id"), F.expr(kind).alias("feedback_type"),
        F.expr("CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN concat('value ', CAST(event_id % 1000 AS STRING)) WHEN event_type = 'click' THEN 'x' END").alias("correction_text"),
        F.array(F.concat(F.lit("m"), F.get_json_object("props", "$.k"))).alias("related_memory_ids"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'an answer' END").alias("answer_text"), F.col("ts").cast("timestamp").alias("created_at"),
    )


FEEDBACK_SQL = (
    "feedback AS (SELECT concat('fb', event_id) AS id, event_id AS n, CASE event_type WHEN 'purchase' THEN 'upvote' WHEN 'error' THEN 'downvote' ELSE 'correct' END AS feedback_type, "
    "CASE WHEN event_type = 'click' AND event_id % 3 > 0 THEN concat('value ', CAST(event_id % 1000 AS VARCHAR)) WHEN event_type = 'click' THEN 'x' END AS correction_text, "
    "concat('m', json_extract_string(props, '$.k')) AS memory_id, CASE WHEN event_id % 2 = 0 THEN 'an answer' END AS answer_text, ts AS created_at FROM events WHERE event_type IN ('purchase', 'error', 'click'))"
)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for every supplier about its nation, and one for every part and its brand."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    a = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat("s_name", F.lit(" depends on "), "n_name", F.lit(";")).alias("text"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.concat(F.lit("part"), F.col("p_partkey"), F.lit(" uses redis, "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(";")).alias("text"))
    return a.unionByName(p)


SENTENCES_SQL = (
    "sentences AS (SELECT concat('s', s_suppkey) AS id, concat(s_name, ' depends on ', n_name, ';') AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "UNION ALL SELECT concat('p', p_partkey), concat('part', p_partkey, ' uses redis, ', regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), ';') FROM part)"
)
