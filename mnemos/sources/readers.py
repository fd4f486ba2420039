"""Readers and writers of exchange formats: cached session items as JSON lines, evaluation cases, id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.schemas import conform

L1_JSON = "id string, content string, memory_type string, importance double, weight double, pinned boolean, user_id string, tenant_id string, session_id string, meta map<string,string>, created_at timestamp"


def l1_from_json(values: DataFrame, value_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """Session items out of JSON texts; missing fields get their defaults."""
    parsed = values.select(F.from_json(value_col, L1_JSON).alias("x"), F.col(seq_col).alias("seq")).select("x.*", "seq")
    return conform(parsed, "l1_items")


def l1_to_json(items: DataFrame) -> DataFrame:
    """session_id, seq and the item as JSON text."""
    names = [c.split()[0] for c in L1_JSON.replace("map<string,string>", "map").split(", ")]
    return items.select("session_id", "seq", F.to_json(F.struct(*names)).alias("value"))


def ids_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def ids_to_json(ids: Column) -> Column:
    return F.to_json(ids.cast("array<string>"))


EVAL_STEP = (
    "op string, user_id string, content string, memory_type string, pinned boolean, importance double, extract_graph boolean, save_as string, "
    "query string, top_k int, text string, entity_name string, direction string, max_hops int, answer_id string, feedback_type string, "
    "correction_text string, related_from string, expect_any_contains array<string>, expect_recommend_contains array<string>, "
    "expect_node_names array<string>, expect_alert_types array<string>, expect_status string"
)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array."""
    return spark.read.option("multiLine", True).schema(_eval_schema()).json(path)


def _eval_schema() -> str:
    fields = ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in EVAL_STEP.split(", ")))
    return f"id string, suite string, description string, steps array<struct<{fields}>>"
