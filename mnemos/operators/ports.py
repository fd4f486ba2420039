"""Language-model clients as ports: a function from prompts to JSON texts, and the rules wherever it gives nothing.

`complete` takes a list of prompts and returns a text or None for each; it runs in the Python workers, a batch at a time, so
it has to be picklable and should make its client once a worker. Nothing here knows a network.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions import scoring as S
from mnemos.functions.text import strip
from mnemos.operators import consolidate, feedback, graph

Complete = Callable[[list[str]], list[str | None]]

DRAFT = "struct<analysis: string, summary: string, confidence: double, memory_type: string, pinned: boolean>"
SUMMARY = "struct<summary: string>"
RELATIONS = "struct<relations: array<struct<from: string, to: string, type: string, confidence: double>>>"


def completed(prompt: Column, complete: Complete, schema: str) -> Column:
    """The parsed answers of a client, null where it fails or gives no such JSON."""

    @F.arrow_udf("string")
    def ask(prompts: pa.Array) -> pa.Array:
        try:
            answers = complete(prompts.to_pylist())
        except Exception:  # the client's failure is the rules' turn
            answers = [None] * len(prompts)
        return pa.array(answers, pa.string())

    return F.from_json(ask(prompt), schema, {"mode": "PERMISSIVE"})


def drafts(events: DataFrame, complete: Complete) -> DataFrame:
    """As feedback.drafts(), by a client; a missing or blank summary falls back to the rules."""
    ruled = feedback.drafts(events)
    prompt = F.to_json(F.struct(F.lit("reflect").alias("task"), "feedback_type", "correction_text", "answer_text", "related"))
    made = ruled.withColumn("answer", completed(prompt, complete, DRAFT))
    a, d = F.col("answer"), F.col("draft")
    own = F.struct(
        F.coalesce(a["analysis"], F.lit("")).alias("analysis"), strip(a["summary"]).alias("summary"), S.clamp(F.coalesce(a["confidence"], F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        F.coalesce(a["memory_type"], d["memory_type"]).alias("memory_type"), F.coalesce(a["pinned"], F.lit(False)).alias("pinned"),
    )
    good = F.coalesce(a["summary"], F.lit("")).rlike(r"(?U)\S") & (F.col("feedback_type") != "upvote")
    return made.withColumn("draft", F.when(good, own).otherwise(d)).drop("answer")


def summaries(rows: DataFrame, complete: Complete, config: EngineConfig = DEFAULT) -> DataFrame:
    """As consolidate.summaries(), by a client over the fragments that the rules pick."""
    ruled = consolidate.summaries(rows, config)
    prompt = F.to_json(F.struct(F.lit("summarise").alias("task"), "topic", "summary"))
    answer = completed(prompt, complete, SUMMARY)["summary"]
    made = ruled.withColumn("answer", strip(answer))
    return made.withColumn("summary", F.when(F.length("answer") > 0, F.col("answer")).otherwise(F.col("summary"))).drop("answer")


def relations(texts: DataFrame, complete: Complete, id_col: str = "id", text_col: str = "text", config: EngineConfig = DEFAULT) -> DataFrame:
    """As graph.extract_relations(), by a client; texts for which it finds none get the rules' relations."""
    prompt = F.to_json(F.struct(F.lit("extract").alias("task"), F.col(text_col).alias("text")))
    asked = texts.select(id_col, text_col, F.posexplode_outer(completed(prompt, complete, RELATIONS)["relations"]).alias("at", "r"))
    from_, to = strip(F.col("r")["from"]), strip(F.col("r")["to"])
    sure = F.coalesce(F.col("r")["confidence"], F.lit(1.0))
    found = asked.where((F.length(from_) > 0) & (F.length(to) > 0) & (sure >= config.extract_confidence)).select(
        id_col, F.struct(F.lit(0).alias("pattern"), F.col("at").cast("int").alias("at"), F.lit(0).alias("part")).alias("ord"), from_.alias("from_name"), to.alias("to_name"),
        F.coalesce(F.col("r")["type"], F.lit("related_to")).alias("relation_type"), sure.alias("confidence"),
    )
    found = found.withColumn("from_type", graph.entity_type(F.col("from_name"))).withColumn("to_type", graph.entity_type(F.col("to_name")))
    left = texts.join(found.select(id_col).distinct(), id_col, "left_anti")
    return found.unionByName(graph.extract_relations(left, id_col, text_col, config))
