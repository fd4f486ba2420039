"""Clients that answer, that fail, and that give nothing."""

import json
import sys

import pytest
from pyspark import cloudpickle

from mnemos.operators import ports

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def answering(prompts):
    out = []
    for p in map(json.loads, prompts):
        if p["task"] == "reflect":
            out.append(json.dumps({"analysis": "a", "summary": " by the client ", "confidence": 7, "memory_type": "fact"}))
        elif p["task"] == "summarise":
            out.append('{"summary": "short"}')
        else:
            out.append(json.dumps({"relations": [{"from": "A", "to": "B", "type": "uses", "confidence": 0.9}, {"from": " ", "to": "B"}, {"from": "A", "to": "C", "confidence": 0.1}]}) if "client" in p["text"] else None)
    return out


def failing(prompts):
    raise OSError


def empty(prompts):
    return ["{not json"] * len(prompts)


EVENTS = "id string, feedback_type string, correction_text string, answer_text string, related array<string>"


@pytest.mark.parametrize("client", [answering, failing, empty])
def test_drafts(spark, client):
    df = spark.createDataFrame([("1", "correct", "应该是 A 不是 B", None, None), ("2", "upvote", None, None, None)], EVENTS)
    got = {r["id"]: r["draft"] for r in ports.drafts(df, client).collect()}
    assert got["1"]["summary"] == ("by the client" if client is answering else "正确事实：A（此前误为 B）")
    assert 0 <= got["1"]["confidence"] <= 1 and got["2"]["summary"] == ""


@pytest.mark.parametrize("client", [answering, failing])
def test_summaries(spark, client):
    rows = [("u", "t:x", i, f"text {i}", 0.5, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "user_id string, cluster string, place long, content string, importance double, weight double")
    (r,) = ports.summaries(df, client).collect()
    assert r["summary"] == "short" if client is answering else r["summary"].startswith("【精华摘要·")


@pytest.mark.parametrize("client", [answering, failing, empty])
def test_relations(spark, client):
    df = spark.createDataFrame([("1", "to the client"), ("2", "X uses Y;")], "id string, text string")
    got = {(r["id"], r["from_name"], r["to_name"], r["relation_type"]) for r in ports.relations(df, client).collect()}
    assert got == ({("1", "A", "B", "uses")} if client is answering else set()) | {("2", "X", "Y", "uses")}
