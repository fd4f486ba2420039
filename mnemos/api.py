"""A facade over the store: what a client calls for one user, as calls on batches of one row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions.vector import hash_embed
from mnemos.operators import alerts, changes, consolidate, feedback, graph, ingest, lookup, migrate
from mnemos.operators import recall as recalling
from mnemos.schemas import TABLES
from mnemos.sources import archive
from mnemos.sources.store import SnapshotStore, Transaction, merge
from mnemos.streaming.jobs import apply_feedback, process_pending


class MemoryEngine:
    """Sessions, memories, recall, graph, feedback, consolidation, migration and archives in one store.

    Arguments out of range raise ValueError, unknown ids KeyError. `clock` gives the time of every call. Each call that writes
    is one transaction of the store, done anew if another writer was faster.
    """

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = DEFAULT, clock: Callable[[], datetime] | None = None, embed: Callable | None = None):
        self.spark, self.config, self.store = spark, config, SnapshotStore(spark, root)
        self.clock = clock or (lambda: datetime.now(UTC).replace(microsecond=0))
        self.embed = embed or hash_embed
        self.metrics: dict[str, int] = {}

    # --- helpers

    def _now(self):
        return F.lit(self.clock()).cast("timestamp")

    def _count(self, name: str, by: int = 1) -> None:
        self.metrics[name] = self.metrics.get(name, 0) + by

    def snapshot(self) -> dict[str, int]:
        """This engine's counters, sorted by name."""
        return dict(sorted(self.metrics.items()))

    def _one(self, schema: str, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], schema)

    def _embedded(self, text: str, **values) -> DataFrame:
        """A one-row frame with the vector of a text; values give further columns."""
        names = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
        row = self.spark.createDataFrame([(0, text, *(v for v, _ in values.values()))], f"query_id long, text string{', ' + names if names else ''}")
        vectors = self.embed(row.select("query_id", "text"), "query_id", "text", self.config.embedding_dim)
        return row.join(vectors, "query_id")

    @staticmethod
    def _within(name: str, value, low, high) -> None:
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} is from {low} to {high}")

    # --- sessions

    def create_session(self, user_id: str | None = None, tenant_id: str | None = None, meta: dict[str, str] | None = None) -> str:
        self._count("sessions_created")
        row = self._one("ord string, tenant_id string, user_id string, meta map<string,string>", ord=uuid.uuid4().hex, tenant_id=tenant_id, user_id=user_id, meta=meta or {})
        made = ingest.open_sessions(row, self._now())
        self.store.upsert("sessions", made)
        return made.first()["id"]

    def close_session(self, session_id: str) -> dict:
        ids, now = self._one("id string", id=session_id), self._now()

        def work(own: Transaction) -> dict:
            own_items, memories = own.read("l1_items").where(F.col("session_id") == session_id), own.read("memories")
            sessions, promoted, _, report = ingest.close(own.read("sessions", [session_id]), ids, own_items, memories, now, self.config)
            row = report.first()
            if row["outcome"] == "not_found":
                raise KeyError(session_id)
            if row["outcome"] == "conflict":
                raise ValueError(f"session {session_id} is closed")
            own.upsert("sessions", sessions)
            own.delete("l1_items", own_items.select("id"))
            own.upsert("memories", promoted)
            own.upsert("embeddings", ingest.embedded(promoted, now, self.config, self.embed))
            return {"id": session_id, "status": "closed", "promoted_count": row["promoted_count"], "dropped_count": row["dropped_count"]}

        told = self.store.transact(work)
        self._count("sessions_closed")
        return told

    # --- memories

    def remember(self, content: str, user_id: str | None = None, tenant_id: str | None = None, session_id: str | None = None, memory_type: str = "fact", importance: float = 0.5, pinned: bool = False, extract_graph: bool | None = None, source: str = "ingest") -> dict:
        self._within("importance", importance, 0, 1)
        self._count("memories_remembered")
        now = self._now()
        schema = "ord long, seed string, content string, user_id string, tenant_id string, session_id string, memory_type string, importance double, pinned boolean"
        row = self._one(schema, ord=0, seed=uuid.uuid4().hex, content=content, user_id=user_id, tenant_id=tenant_id, session_id=session_id, memory_type=memory_type, importance=float(importance), pinned=pinned)

        def work(own: Transaction) -> dict:
            items = own.read("l1_items") if session_id is not None else self.spark.createDataFrame([], TABLES["l1_items"])
            items = items.where(F.col("session_id") == session_id) if session_id is not None else items
            made = ingest.remember(row, items, now, self.config, self.embed)
            told = made.rows.first()
            found = self.detect_alerts(user_id, content, told["id"], tenant_id) if user_id else []
            own.upsert("memories", made.memories.withColumn("source", F.lit(source)))
            own.upsert("embeddings", made.embeddings)
            if session_id is not None:
                own.upsert("l1_items", made.l1_items.join(items.select("id"), "id", "left_anti"))
                own.delete("l1_items", items.select("id").join(made.l1_items.select("id"), "id", "left_anti"))
            counts = {"entities": 0, "relations": 0}
            if user_id and (self.config.extract_on_remember if extract_graph is None else extract_graph):
                text = self._one("id string, user_id string, tenant_id string, text string, source_memory_id string", id=told["id"], user_id=user_id, tenant_id=tenant_id, text=content, source_memory_id=told["id"])
                counts = self._extracted(own, text)
            return {"id": told["id"], "layer": told["layer"], "pinned": told["pinned"], "importance": told["importance"], "entities_extracted": counts["entities"], "relations_extracted": counts["relations"], "alerts": found}

        return self.store.transact(work)

    def _extracted(self, own: Transaction, text: DataFrame) -> dict:
        """Put the graph of a text into a transaction; returns its counts. A text without relations reads and writes nothing."""
        none = {k: self.spark.createDataFrame([], TABLES[k]) for k in ("entities", "relations")}
        counts = graph.ingest(text, none["entities"], none["relations"], self._now(), self.config)[2].first().asDict()
        if counts["entities"] or counts["relations"]:
            entities, relations, _ = graph.ingest(text, own.read("entities"), own.read("relations"), self._now(), self.config)
            own.put("entities", entities)
            own.put("relations", relations)
        return counts

    def pin(self, memory_id: str | None = None, content: str | None = None, pinned: bool = True, **options) -> dict:
        """Pin (or unpin) a memory, or remember a new pinned one."""
        if memory_id is None:
            if not content:
                raise ValueError("a memory or a content is needed")
            return self.remember(content, memory_type="identity", importance=1.0, pinned=True, **options)
        row, now = self._one("id string, pin boolean", id=memory_id, pin=pinned), self._now()

        def work(own: Transaction) -> dict:
            hit = changes.set_pinned(own.read("memories", [memory_id]), row, now).where("repinned").drop("repinned")
            if hit.isEmpty():
                raise KeyError(memory_id)
            own.upsert("memories", hit)
            own.upsert("embeddings", ingest.embedded(hit, now, self.config, self.embed))
            return {"id": memory_id, "pinned": pinned}

        return self.store.transact(work)

    def recall(self, user_id: str, query: str, session_id: str | None = None, tenant_id: str | None = None, top_k: int | None = None, include_pinned: bool = True, min_score: float | None = None, touch: bool = True) -> list[dict]:
        self._within("top_k", top_k, 1, 100)
        self._within("min_score", min_score, 0, 1)
        self._count("recalls")
        q = self._embedded(query, user_id=(user_id, "string"), session_id=(session_id, "string"), tenant_id=(tenant_id, "string"), top_k=(top_k, "int"), include_pinned=(include_pinned, "boolean"), min_score=(min_score, "double")).withColumnRenamed("text", "query")
        items = None
        if session_id is not None:
            items = self.store.read("l1_items").where(F.col("session_id") == session_id)
            items = items.join(self.embed(items.select("id", "content"), "id", "content", self.config.embedding_dim), "id", "left")
        found = [r.asDict() for r in recalling.recall(q, self.store.read("memories"), self.store.read("embeddings"), self._now(), items, self.config).orderBy("rank").collect()]
        used = [(r["id"],) for r in found if r["layer"] == "L2"]
        if touch and used:
            ids, now = self.spark.createDataFrame(used, "id string"), self._now()
            self.store.transact(lambda own: own.upsert("memories", changes.touch(own.read("memories", [i for (i,) in used]), ids, now)))
        return found

    def recommend(self, user_id: str, query: str, exclude: list[str] | None = None, top_k: int | None = None, tenant_id: str | None = None) -> list[dict]:
        q = self._embedded(query, user_id=(user_id, "string"), exclude=(exclude or [], "array<string>"), top_k=(top_k, "int"), tenant_id=(tenant_id, "string")).withColumnRenamed("text", "query")
        return [r.asDict() for r in recalling.recommend(q, self.store.read("memories"), self.store.read("embeddings"), self.config).orderBy("rank").collect()]

    def detect_alerts(self, user_id: str, content: str, exclude_id: str | None = None, tenant_id: str | None = None) -> list[dict]:
        c = self._embedded(content, user_id=(user_id, "string"), exclude_id=(exclude_id, "string"), tenant_id=(tenant_id, "string")).withColumnRenamed("text", "content")
        return [r.asDict() for r in alerts.detect(c, self.store.read("memories"), self.store.read("embeddings"), self.config).orderBy("rank").collect()]

    def apply_decay(self, threshold: float | None = None) -> int:
        """Soft-delete what has decayed; returns how many."""
        now = self._now()

        def work(own: Transaction) -> int:
            rows = own.read("memories")
            gone = changes.decayed(rows, now, threshold, self.config).select("id")
            own.upsert("memories", changes.soft_delete(rows, gone, now).where("changed").drop("changed"))
            own.delete("embeddings", gone)
            return gone.count()

        return self.store.transact(work)

    # --- graph

    def extract(self, user_id: str | None = None, text: str | None = None, memory_id: str | None = None, tenant_id: str | None = None) -> dict:
        if text is None:
            if memory_id is None:
                raise ValueError("a text or a memory is needed")
            row = self.store.read("memories", keys=[memory_id]).where(F.col("deleted_at").isNull()).first()
            if row is None:
                raise KeyError(memory_id)
            if not row["user_id"]:
                raise ValueError("the memory has no user")
            user_id, tenant_id, text = row["user_id"], row["tenant_id"], row["content"]
        source = self._one("id string, user_id string, tenant_id string, text string, source_memory_id string", id="t", user_id=user_id, tenant_id=tenant_id, text=text, source_memory_id=memory_id)
        counts = self.store.transact(lambda own: self._extracted(own, source))
        return {"entities": counts["entities"], "relations": counts["relations"]}

    def entities(self, user_id: str, q: str | None = None, entity_type: str | None = None, tenant_id: str | None = None, limit: int = 50) -> list[dict]:
        if limit < 1:
            raise ValueError("limit is 1 or more")
        return [r.asDict() for r in lookup.search_entities(self.store.read("entities"), user_id, q, entity_type, tenant_id, limit).collect()]

    def impact(self, user_id: str, entity: str, direction: str = "inbound", max_hops: int | None = None, tenant_id: str | None = None) -> list[dict]:
        self._within("max_hops", max_hops, 1, 5)
        e = graph.of_tenant(self.store.read("entities"), tenant_id)
        seeds = graph.with_seeds(self._one("seed_id long, user_id string, entity_name string", seed_id=0, user_id=user_id, entity_name=entity), e)
        if seeds.isEmpty():
            raise KeyError(entity)
        found = graph.impact(seeds, e, self.store.read("relations"), direction, max_hops, self.config, tenant_id)
        return [{"hops": r["hops"], "nodes": [n.asDict() for n in r["nodes"]], "edges": [x.asDict() for x in r["edges"]]} for r in graph.ranked(found).orderBy("rank").collect()]

    # --- feedback

    def submit_feedback(self, user_id: str, answer_id: str, feedback_type: str, session_id: str | None = None, tenant_id: str | None = None, correction_text: str | None = None, related_memory_ids: list[str] | None = None, answer_text: str | None = None, wait: bool | None = None) -> dict:
        schema = "id string, tenant_id string, user_id string, session_id string, answer_id string, feedback_type string, correction_text string, related_memory_ids array<string>, answer_text string, created_at timestamp"
        row = (f"fb_{uuid.uuid4().hex}", tenant_id, user_id, session_id, answer_id, feedback_type, correction_text, related_memory_ids or [], answer_text, self.clock())
        later = self.config.feedback_async if wait is None else not wait
        problems = apply_feedback(self.store, self.spark.createDataFrame([row], schema), self.clock(), self.config, pending=later)
        problem = problems.first()
        if problem is not None:
            raise ValueError(problem["problem"])
        return self.get_feedback(row[0])

    def process_pending(self) -> None:
        process_pending(self.store, self.clock(), self.config)

    def get_feedback(self, feedback_id: str) -> dict:
        events = self.store.read("feedback_events", keys=[feedback_id])
        row = feedback.with_reflection(events, self.store.read("reflection_records")).first()
        if row is None:
            raise KeyError(feedback_id)
        return row.asDict()

    # --- upkeep

    def consolidate(self) -> list[dict]:
        """Consolidate all users; returns their reports, the sums over which are counted once the change is committed."""
        now = self._now()

        def work(own: Transaction) -> tuple[list[dict], dict[str, int]]:
            rows, vectors, report = consolidate.consolidate(own.read("memories"), own.read("embeddings"), now, self.config)
            made = rows.where("source = 'consolidation' AND deleted_at IS NULL").join(vectors.select(F.col("memory_id").alias("id")), "id", "left_anti")
            fresh = ingest.embedded(made, now, self.config, self.embed)
            own.put("memories", rows)
            own.put("embeddings", merge(vectors, fresh, ["memory_id"]))
            report, seen = consolidate.observed(report)
            return [r.asDict() for r in report.collect()], seen.get

        told, sums = self.store.transact(work)
        self._count("consolidations")
        for name, n in sums.items():
            self._count(f"consolidation_{name}", n)
        return told

    def reembed(self, dry_run: bool = False, **options) -> dict:
        """Bring all vectors up to date; all users' rows are embedded in Arrow batches of one distributed plan."""
        now = self._now()

        def work(own: Transaction) -> dict:
            memories, vectors, report = migrate.reembed(own.read("memories"), own.read("embeddings"), now, self.config, dry_run=dry_run, embed=self.embed, **options)
            if not dry_run:
                own.put("memories", memories)
                own.put("embeddings", vectors)
            return report.first().asDict()

        return self.store.transact(work)

    def reembed_in_parts(self, run: str, **options) -> dict:
        """Re-embedding in commits of some rows each; a stopped run goes on where it was."""
        return migrate.reembed_in_parts(self.store, self._now(), run, self.config, embed=self.embed, **options)

    def dump(self, root: str, user_id: str | None = None) -> dict:
        parts = archive.sections(self.store.read("memories"), self.store.read("entities"), self.store.read("relations"), user_id)
        row = archive.dump(self.spark, parts, root, self.clock(), user_id)
        self.store.upsert("l3_archives", row)
        return row.first().asDict()

    def archives(self, limit: int = 20) -> list[dict]:
        self._within("limit", limit, 1, 100)
        return [r.asDict() for r in archive.latest(self.store.read("l3_archives"), limit).collect()]

    # --- tools

    def dispatch(self, name: str, arguments: str | dict[str, Any] | None = None) -> dict:
        """Call a method by its name with JSON or dict arguments; errors come back as {ok: false}."""
        tools = {"remember": self.remember, "recall": self.recall, "impact": self.impact, "feedback": self.submit_feedback, "recommend": self.recommend, "consolidate": self.consolidate, "health": lambda: {"status": "ok", "metrics": self.snapshot()}}
        try:
            own = json.loads(arguments) if isinstance(arguments, str) else dict(arguments or {})
            if name not in tools:
                return {"ok": False, "error": f"unknown tool {name}"}
            return {"ok": True, "result": tools[name](**own)}
        except Exception as error:  # a tool's caller gets every failure as data
            return {"ok": False, "error": str(error)}
