"""Scenarios against the facade: each case is a list of steps with expectations, and a failed case tells which one broke."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.api import MemoryEngine

RESULTS = "id string, suite string, passed boolean, detail string"


class Missed(Exception):
    """An expectation that didn't come true."""


def _present(wanted: list | None, found: list[str], what: str, inside: bool = False) -> None:
    """Every wanted text is one of the found ones, or (inside) a part of one."""
    for w in wanted or []:
        if not any(w in x if inside else w == x for x in found):
            raise Missed(f"{what}: {w!r} isn't among {sorted(found)!r}")


class Scenario:
    """One case: a session that may be open, and the ids that steps saved under names."""

    def __init__(self, engine: MemoryEngine):
        self.engine, self.session, self.saved = engine, None, {}

    def step(self, own: dict) -> None:
        action: Callable | None = getattr(self, f"do_{own['op']}", None)
        if action is None:
            raise Missed(f"unknown step {own['op']}")
        action(own)

    def do_session_create(self, own: dict) -> None:
        self.session = self.engine.create_session(own["user_id"])

    def do_session_close(self, own: dict) -> None:
        if self.session is None:
            raise Missed("no session is open")
        self.engine.close_session(self.session)
        self.session = None

    def do_remember(self, own: dict) -> None:
        given = {k: own[k] for k in ("memory_type", "importance") if own[k] is not None}
        made = self.engine.remember(own["content"], own["user_id"], session_id=self.session, pinned=bool(own["pinned"]), extract_graph=bool(own["extract_graph"]), **given)
        if own["save_as"]:
            self.saved[own["save_as"]] = made["id"]
        _present(own["expect_alert_types"], [a["type"] for a in made["alerts"]], "alerts")

    def do_recall(self, own: dict) -> None:
        found = self.engine.recall(own["user_id"], own["query"], top_k=own["top_k"] or 8)
        _present(own["expect_any_contains"], [r["content"] for r in found], "recall", inside=True)
        if own["expect_recommend_contains"]:
            beside = self.engine.recommend(own["user_id"], own["query"])
            _present(own["expect_recommend_contains"], [r["content"] for r in beside], "recommendations", inside=True)

    def do_extract(self, own: dict) -> None:
        self.engine.extract(own["user_id"], own["text"])

    def do_impact(self, own: dict) -> None:
        paths = self.engine.impact(own["user_id"], own["entity_name"], own["direction"] or "inbound", own["max_hops"] or 2)
        _present(own["expect_node_names"], [n["name"] for p in paths for n in p["nodes"]], "impact")

    def do_feedback(self, own: dict) -> None:
        related = [self.saved[own["related_from"]]] if own["related_from"] else []
        told = self.engine.submit_feedback(own["user_id"], own["answer_id"], own["feedback_type"], correction_text=own["correction_text"], related_memory_ids=related, wait=True)
        if own["expect_status"]:
            _present([own["expect_status"]], [str(told.get("status"))], "feedback")


def run_cases(cases: DataFrame, engine: MemoryEngine) -> DataFrame:
    """id, suite, passed and detail of every case (see sources.readers.eval_cases), run one after the other.

    Cases are scripts of calls with side effects on one store, so they run on the driver; a few, by their nature.
    """
    rows = []
    for case in cases.collect():
        scenario, detail = Scenario(engine), "ok"
        try:
            for s in case["steps"]:
                scenario.step(s.asDict(recursive=True))
        except (Missed, KeyError, ValueError) as error:
            detail = f"{type(error).__name__}: {error}"
        rows.append((case["id"], case["suite"] or "misc", detail == "ok", detail))
    return engine.spark.createDataFrame(rows, RESULTS)


def report(results: DataFrame) -> DataFrame:
    """total, passed and failed."""
    passed = F.count_if("passed")
    return results.agg(F.count("*").alias("total"), passed.alias("passed"), (F.count("*") - passed).alias("failed"))
