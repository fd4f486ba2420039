"""Scenarios through the facade: eight that hold, and some that have to fail."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from mnemos import evaluation
from mnemos.api import MemoryEngine
from mnemos.config import EngineConfig
from mnemos.sources.readers import eval_cases

say = lambda user, content, **more: {"op": "remember", "user_id": user, "content": content, "extract_graph": False, **more}
ask = lambda user, query, *found, **more: {"op": "recall", "user_id": user, "query": query, "expect_any_contains": list(found), **more}
reach = lambda user, entity, direction, *names: {"op": "impact", "user_id": user, "entity_name": entity, "direction": direction, "max_hops": 2, "expect_node_names": list(names)}

CASES = {
    "pinned": [{"op": "session_create", "user_id": "a"}, say("a", "用户名为 kim", memory_type="identity", pinned=True, importance=1.0), say("a", "今天下雨", memory_type="episode", importance=0.1), {"op": "session_close"}, ask("a", "用户名是什么", "kim")],
    "corrected": [
        say("b", "数据库使用 MySQL", importance=0.9, save_as="old"),
        {"op": "feedback", "user_id": "b", "answer_id": "x", "feedback_type": "correct", "correction_text": "应该是 PostgreSQL 不是 MySQL", "related_from": "old", "expect_status": "accepted"},
        ask("b", "数据库是 PostgreSQL 吗", "PostgreSQL"),
    ],
    "inbound": [{"op": "extract", "user_id": "c", "text": "订单服务依赖库存服务和Redis。网关服务依赖订单服务。"}, reach("c", "订单服务", "inbound", "网关服务")],
    "outbound": [{"op": "extract", "user_id": "d", "text": "订单服务依赖库存服务和Redis。"}, reach("d", "订单服务", "outbound", "库存服务", "Redis")],
    "two_hops": [{"op": "extract", "user_id": "e", "text": "订单服务依赖库存服务。网关服务依赖订单服务。页面服务依赖网关服务。"}, reach("e", "订单服务", "inbound", "页面服务")],
    "fact": [say("f", "接口层采用 FastAPI 实现", importance=0.5), ask("f", "接口层的框架是什么", "FastAPI")],
    "shift": [say("g", "后端主栈是 Java 与 Spring Boot", importance=0.9), say("g", "新项目改用 Go 重写网关", importance=0.9, expect_alert_types=["tech_stack_shift"])],
    "beside": [say("h", "上次把支付超时调到10秒并加了重试", importance=0.95), say("h", "会议室的灯换成了暖色", importance=0.9), {**ask("h", "改超时配置要注意什么", top_k=1), "expect_recommend_contains": ["超时"]}],
}
BROKEN = {
    "missing": [say("i", "a red lamp", importance=0.9), ask("i", "lamp", "green")],
    "unknown_step": [{"op": "dance"}],
    "closed": [{"op": "session_close"}],
    "no_entity": [reach("j", "nothing", "inbound", "x")],
}


@pytest.mark.parametrize(("cases", "passed"), [(CASES, True), (BROKEN, False)])
def test_cases(spark, tmp_path, cases, passed):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"id": k, "suite": "s", "steps": v} for k, v in cases.items()]))
    config = EngineConfig(embedding_dim=128, min_score=0.0, alert_similarity=0.2, recommend_min_score=0.05, extract_on_remember=False)
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", config, clock=lambda: datetime(2026, 7, 29, tzinfo=UTC))
    results = evaluation.run_cases(eval_cases(spark, f"file://{path}"), engine)
    assert {r["id"]: r["passed"] for r in results.collect()} == dict.fromkeys(cases, passed), results.collect()
    told = evaluation.report(results).first()
    assert (told["total"], told["failed"]) == (len(cases), 0 if passed else len(cases))


def test_a_tenant_walks_its_own_edges_only(spark):
    from mnemos.operators import graph

    of = lambda names, rows: spark.createDataFrame(rows, names)
    entities = of("id string, tenant_id string, user_id string, name string, entity_type string", [("a", "t", "u", "a", "other"), ("b", "t", "u", "b", "other"), ("c", "s", "u", "c", "other"), ("d", None, "u", "d", "other")])
    columns = "id string, tenant_id string, user_id string, from_entity_id string, to_entity_id string, relation_type string, weight double, confidence double, created_at timestamp, deleted_at timestamp"
    now = datetime(2026, 1, 1)
    relations = of(columns, [("1", "t", "u", "a", "b", "uses", 1.0, 1.0, now, None), ("2", "s", "u", "a", "c", "uses", 1.0, 1.0, now, None), ("3", "t", "u", "b", "d", "uses", 1.0, 1.0, now, None), ("4", "s", "u", "b", "a", "uses", 1.0, 1.0, now, None)])
    seeds = of("seed_id long, user_id string, entity_id string", [(0, "u", "a")])
    ends = lambda **more: sorted(r["end_name"] for r in graph.impact(seeds, entities, relations, "outbound", 2, **more).collect())
    assert ends() == ["b", "c", "d"] and ends(tenant_id="t") == ["b"] and ends(tenant_id="s") == [] and ends(tenant_id="x") == []
    edges = graph.impact(seeds, entities, relations, "outbound", 2, tenant_id="t").select(F.explode("edges.id")).collect()
    assert [r[0] for r in edges] == ["1"]
