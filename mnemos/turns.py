"""Host turns: what a conversation's text asks of the engine, as columns over many turns, and text blocks for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions import vocabulary as V
from mnemos.functions.text import strip


def impact_entity(text: Column) -> Column:
    """The entity that an impact question is about, or null."""
    named = F.regexp_extract(text, r"(?U)(?:改|关于)?\s*([A-Za-z0-9_\-]+服务|[A-Za-z][\w\-]+)\s*", 1)
    other = F.regexp_extract(text, r"([一-龥A-Za-z0-9_\-]+服务)", 1)
    found = F.when(named != "", named).when(other != "", other)
    return F.when(text.rlike(f"(?iU){V.IMPACT_HINTS}"), found)


def routed(turns: DataFrame) -> DataFrame:
    """turns (user_text, and maybe user_feedback) with `route` and how a remembered text is kept.

    feedback where it is explicit, correct where the wording corrects, remember for facts (0.75) and identities (pinned, 0.95)
    of four characters or more, else none; `entity` is what an impact question is about.
    """
    text = strip(F.coalesce("user_text", F.lit("")))
    given = F.col("user_feedback").isNotNull() if "user_feedback" in turns.columns else F.lit(False)
    identity = text.rlike(f"(?iU){V.IDENTITY_HINTS}")
    fact = text.rlike(f"(?iU){V.FACT_HINTS}") | identity
    route = F.when(given, "feedback").when(text.rlike(f"(?iU){V.CORRECTION_HINTS}"), "correct").when((F.length(text) >= 4) & fact, "remember").otherwise("none")
    out = turns.withColumn("route", route).withColumn("entity", impact_entity(F.col("user_text")))
    keeps = F.col("route") == "remember"
    return out.withColumn("memory_type", F.when(keeps, F.when(identity, "identity").otherwise("fact"))).withColumn("importance", F.when(keeps, F.when(identity, 0.95).otherwise(0.75))).withColumn("pinned", keeps & identity)


def recall_block(found: list[dict]) -> str:
    head = "### Recalled memories"
    rows = [f"- ({r['layer']}, score={r['score']:.2f}){' [pinned]' if r['pinned'] else ''} {r['content']}" for r in found]
    return "\n".join([head, *(rows or ["(none)"])])


def recommendation_block(found: list[dict], reason: str = "related") -> str:
    return "\n".join(["### Related recommendations", *(f"- ({reason}, score={r['score']:.2f}) {r['content']}" for r in found)]) if found else ""


def impact_block(entity: str, paths: list[dict]) -> str:
    rows = ["- " + " → ".join(n["name"] for n in p["nodes"]) for p in paths]
    return "\n".join([f"### Impact: changing `{entity}` may affect", *(rows or ["(no inbound dependents found)"])])


def before_turn(engine, user_id: str, user_text: str, session_id: str | None = None, top_k: int = 6) -> dict:
    """Memories for a user's text, and the paths into the entity that it asks about."""
    found = engine.recall(user_id, user_text, session_id=session_id, top_k=top_k)
    row = engine.spark.createDataFrame([(user_text,)], "user_text string").select(impact_entity(F.col("user_text")).alias("e")).first()
    blocks, paths = [recall_block(found)], []
    if row["e"]:
        try:
            paths = engine.impact(user_id, row["e"])
            blocks.append(impact_block(row["e"], paths))
        except KeyError:
            paths = []
    return {"memories": found, "impact": paths, "text": "\n\n".join(blocks)}


def after_turn(engine, user_id: str, user_text: str, answer_id: str, answer_text: str | None = None, user_feedback: str | None = None, correction_text: str | None = None, recalled: list[str] | None = None, session_id: str | None = None) -> dict | None:
    """Feedback, a correction or a new memory, as the text's wording asks."""
    row = routed(engine.spark.createDataFrame([(user_text, user_feedback)], "user_text string, user_feedback string")).first()
    common = {"session_id": session_id, "related_memory_ids": recalled, "answer_text": answer_text}
    if row["route"] == "feedback":
        return engine.submit_feedback(user_id, answer_id, user_feedback, correction_text=correction_text, **common)
    if row["route"] == "correct":
        return engine.submit_feedback(user_id, answer_id, "correct", correction_text=user_text, **common)
    if row["route"] == "remember":
        return engine.remember(user_text.strip(), user_id, session_id=session_id, memory_type=row["memory_type"], importance=row["importance"], pinned=row["pinned"])
    return None
