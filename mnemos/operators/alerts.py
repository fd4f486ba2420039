"""Alerts about new contents: shifts of the technology stack and conflicts with what is remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import vocabulary as V
from mnemos.functions.text import cut, near_duplicate, stack_shift, stacks, tokens
from mnemos.functions.vector import hinted, nearest, rows_of
from mnemos.operators.lookup import active, newest_by_user

CONFLICT_MARGIN = 0.08
SCAN_SIMILARITY = 0.75


def conflicting(new: Column, old: Column, new_stacks: Column, old_stacks: Column) -> Column:
    """No near duplicates, and either different stacks or a negation in the new text with two words in common."""
    apart = (F.size(new_stacks) > 0) & (F.size(old_stacks) > 0) & ~F.arrays_overlap(new_stacks, old_stacks)
    common = F.size(F.array_intersect(tokens(new, 2), tokens(old, 2))) >= 2
    return ~near_duplicate(new, old) & (apart | (new.rlike(V.ALERT_NEGATION) & common))


def shift_message(shift: Column, content: Column) -> Column:
    a, b, c, d = V.SHIFT_MESSAGE
    return F.concat(F.lit(a), shift["old"], F.lit(b), shift["new"], F.lit(c), cut(content, 48), F.lit(d))


def detect(contents: DataFrame, memories: DataFrame, embeddings: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, type, severity, message, memory_id and rank of the alerts of new contents.

    contents: query_id, user_id, content, vector, and maybe exclude_id, tenant_id. The nearest neighbours are looked at, and
    recent rows too where the new text speaks of a shift; of alerts alike (type and 80 characters) the most severe stays.
    """
    c = contents
    for name in ("exclude_id", "tenant_id"):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast("string"))
    if not config.alerts_enabled:
        c = c.where("false")
    c = c.where("user_id IS NOT NULL").withColumn("new_stacks", stacks(F.col("content"), config.stacks)).withColumn("hinted", F.col("content").rlike(V.SHIFT_HINTS))
    asked = c.select("query_id", F.col("content").alias("new"), "exclude_id", F.col("tenant_id").alias("asked"), "new_stacks", "hinted")
    rows = active(memories).select("id", F.col("tenant_id").alias("own"), F.col("content").alias("old"))
    visible = (F.col("exclude_id").isNull() | (F.col("id") != F.col("exclude_id"))) & (F.col("asked").isNull() | F.col("asked").eqNullSafe(F.col("own")))
    few, k = rows_of(contents), max(config.neighbor_k, 5)
    hits = nearest(c.select("query_id", "user_id", "vector"), embeddings, k, rows=few)
    near = rows.join(hinted(hits, few * k), rows["id"] == hits["memory_id"]).join(hinted(asked, few), "query_id").where(visible)
    near = near.withColumn("sim", F.greatest(F.lit(0.0), F.col("similarity"))).where(F.col("sim") >= config.alert_similarity)
    near = near.withColumn("old_stacks", stacks(F.col("old"), config.stacks)).withColumn("shift", stack_shift(F.col("old_stacks"), F.col("new_stacks")))
    conflict = F.col("shift").isNull() & (F.col("sim") >= config.alert_similarity + CONFLICT_MARGIN) & conflicting(F.col("new"), F.col("old"), F.col("new_stacks"), F.col("old_stacks"))
    kind = F.when(F.col("shift").isNotNull(), "tech_stack_shift").when(conflict, "conflict")
    first = near.select("query_id", "id", "old", "shift", "sim", kind.alias("type"), F.lit(1).alias("pass"), F.col("rank").alias("order")).where("type IS NOT NULL")
    recent = newest_by_user(memories, config.scan_limit).select("user_id", "id", F.col("tenant_id").alias("own"), F.col("content").alias("old"), "place")
    scan = recent.join(hinted(c.where(F.col("hinted") & (F.size("new_stacks") > 0)).select("query_id", "user_id"), few), "user_id").join(hinted(asked, few), "query_id").where(visible)
    scan = scan.withColumn("shift", stack_shift(stacks(F.col("old"), config.stacks), F.col("new_stacks"))).where("shift IS NOT NULL")
    second = scan.select("query_id", "id", "old", "shift", F.lit(SCAN_SIMILARITY).alias("sim"), F.lit("tech_stack_shift").alias("type"), F.lit(2).alias("pass"), F.col("place").alias("order"))
    both = first.unionByName(second)
    severity = F.when(F.col("type") == "tech_stack_shift", F.least(F.lit(1.0), 0.55 + 0.45 * F.col("sim"))).otherwise(F.least(F.lit(1.0), F.col("sim")))
    message = F.when(F.col("type") == "tech_stack_shift", shift_message(F.col("shift"), F.col("old"))).otherwise(F.concat(F.lit(V.CONFLICT_MESSAGE[0]), cut(F.col("old"), 48), F.lit(V.CONFLICT_MESSAGE[1])))
    told = both.withColumn("severity", severity).withColumn("message", message)
    order = [F.desc("severity"), F.col("pass"), F.col("order"), F.col("id")]
    once = told.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "type", cut(F.col("message"), 80)).orderBy(*order))).where("n = 1")
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= config.alert_max_items)
    return top.select("query_id", "type", "severity", "message", F.col("id").alias("memory_id"), "rank")


def near_duplicates(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with near_duplicate of two text columns."""
    return pairs.withColumn("near_duplicate", near_duplicate(F.col(a), F.col(b)))
