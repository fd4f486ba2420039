"""Declared schemas of all tables; readers never infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSIONS = "id string, tenant_id string, user_id string, status string, meta_json string, created_at timestamp, closed_at timestamp"
MEMORIES = (
    "id string, tenant_id string, user_id string, session_id string, content string, memory_type string, importance double, weight double, "
    "pinned boolean, decay_lambda double, source string, meta_json string, created_at timestamp, updated_at timestamp, "
    "last_accessed_at timestamp, access_count int, deleted_at timestamp"
)
EMBEDDINGS = "memory_id string, user_id string, model string, dim int, vector array<float>, created_at timestamp"
L1_ITEMS = (
    "id string, session_id string, seq long, content string, memory_type string, importance double, weight double, pinned boolean, "
    "user_id string, tenant_id string, meta map<string,string>, created_at timestamp"
)
ENTITIES = "id string, tenant_id string, user_id string, name string, entity_type string, aliases array<string>, meta_json string, created_at timestamp, updated_at timestamp"
RELATIONS = (
    "id string, tenant_id string, user_id string, from_entity_id string, to_entity_id string, relation_type string, weight double, "
    "confidence double, source_memory_id string, created_at timestamp, deleted_at timestamp"
)
FEEDBACK_EVENTS = (
    "id string, tenant_id string, user_id string, session_id string, answer_id string, feedback_type string, correction_text string, "
    "related_memory_ids array<string>, answer_text string, created_at timestamp"
)
REFLECTIONS = "id string, feedback_id string, analysis string, summary string, confidence double, derived_memory_id string, status string, created_at timestamp"
ARCHIVES = "id string, uri string, checksum string, memory_count int, entity_count int, relation_count int, created_at timestamp"
REEMBED_PARTS = "id string, run string, part int, parts int, reembedded long, orphans_assigned long, dangling_removed long, created_at timestamp"
FEEDBACK_FAILED = "id string, problem string, event string, created_at timestamp"

TABLES = {
    "sessions": SESSIONS,
    "memories": MEMORIES,
    "embeddings": EMBEDDINGS,
    "l1_items": L1_ITEMS,
    "entities": ENTITIES,
    "relations": RELATIONS,
    "feedback_events": FEEDBACK_EVENTS,
    "reflection_records": REFLECTIONS,
    "l3_archives": ARCHIVES,
    "reembed_parts": REEMBED_PARTS,
    "feedback_failed": FEEDBACK_FAILED,
}
#: What tells a table's rows apart.
KEYS = dict.fromkeys(TABLES, "id") | {"embeddings": "memory_id"}
#: Values of columns that rows of older versions don't have.
DEFAULTS = {
    "memories": {"memory_type": "fact", "importance": 0.5, "weight": 1.0, "pinned": False, "source": "manual", "meta_json": "{}", "access_count": 0},
    "l1_items": {"memory_type": "fact", "importance": 0.5, "weight": 1.0, "pinned": False},
    "entities": {"entity_type": "other", "meta_json": "{}"},
    "relations": {"relation_type": "related_to", "weight": 1.0, "confidence": 1.0},
    "sessions": {"status": "open", "meta_json": "{}"},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the declared columns and types of a table: missing columns come as their default or null, others go."""
    out = []
    have = set(df.columns)
    for field in _fields(table):
        name, kind = field
        value = F.col(name) if name in have else F.lit(None)
        default = DEFAULTS.get(table, {}).get(name)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _fields(table: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(TABLES[table])]
