"""Scenarios over the store: what a client sees."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemos.api import MemoryEngine
from mnemos.config import EngineConfig

START = datetime(2026, 7, 29, tzinfo=UTC)


class Clock:
    def __init__(self):
        self.at = START

    def __call__(self):
        return self.at


@pytest.fixture
def make(spark, tmp_path):
    def engine(**options):
        clock = Clock()
        options = {"embedding_dim": 64, "min_score": 0.0, "min_score_no_lexical": 0.0, "alert_similarity": 0.2, "recommend_min_score": 0.05, "extract_on_remember": False} | options
        e = MemoryEngine(spark, f"file://{tmp_path}/store", EngineConfig(**options), clock)
        e.test_clock = clock
        return e

    return engine


def contents(engine, where="deleted_at IS NULL"):
    return {r["content"] for r in engine.store.read("memories").where(where).collect()}


def test_remember_recall_and_touch(make):
    e = make()
    a = e.remember("项目使用 FastAPI", "u")
    assert a["layer"] == "L2" and e.remember("今天天气不错", "u", importance=0.1, memory_type="episode")["layer"] == "none"
    e.remember("a secret of someone else", "v", importance=0.9)
    found = e.recall("u", "FastAPI 项目")
    assert [r["id"] for r in found] == [a["id"]]
    row = e.store.read("memories").where(F.col("id") == a["id"]).first()
    assert row["access_count"] == 1 and row["last_accessed_at"] is not None
    assert e.recall("u", "FastAPI", min_score=0.99) == []


def test_pinned_ranking_and_gates(make):
    e = make(min_score=0.25, min_score_no_lexical=0.38, embedding_dim=128)
    facts = ["用户名为 cc", "数据库使用 PostgreSQL", "老大喜欢吃螺蛳粉加炸蛋"]
    for f in facts:
        e.pin(content=f, user_id="u")
    assert e.recall("u", "数据库用什么")[0]["content"] == facts[1]
    assert e.recall("u", "螺蛳粉 喜欢")[0]["content"] == facts[2]
    assert e.recall("u", "quantum chromodynamics lattice") == []
    assert e.recall("u", "数据库用什么", include_pinned=False) == []


def test_session_close(make):
    e = make()
    s = e.create_session("u")
    e.remember("hello there", "u", session_id=s, importance=0.2, memory_type="episode")
    e.remember("我们的项目名为 mnemos", "u", session_id=s, pinned=True)
    told = e.close_session(s)
    assert told["dropped_count"] >= 1 and told["promoted_count"] >= 1
    assert e.store.read("l1_items").count() == 0
    with pytest.raises(ValueError):
        e.close_session(s)
    with pytest.raises(KeyError):
        e.close_session("sess_none")
    assert e.recall("u", "项目")[0]["pinned"]


def test_decay_spares_the_pinned(make):
    e = make()
    e.remember("用户名为 cc", "u", pinned=True, memory_type="identity")
    e.remember("an old episode with api and redis", "u", importance=0.7)
    e.test_clock.at = START + timedelta(days=365)
    assert e.apply_decay(0.5) == 1
    assert contents(e) == {"用户名为 cc"}


def test_graph(make):
    e = make()
    e.extract("u", "A服务依赖B服务和Redis。C服务依赖A服务。D服务依赖C服务。")
    names = lambda paths: [[n["name"] for n in p["nodes"]] for p in paths]
    assert names(e.impact("u", "A服务", "inbound", 2)) == [["A服务", "C服务"], ["A服务", "C服务", "D服务"]]
    assert names(e.impact("u", "a 服务", "outbound", 1)) == [["A服务", "B服务"], ["A服务", "Redis"]]
    assert {r["name"]: r["entity_type"] for r in e.entities("u")} == {"A服务": "service", "B服务": "service", "Redis": "tech", "C服务": "service", "D服务": "service"}
    before = e.store.read("relations").count()
    e.extract("u", "A服务依赖于B服务。")
    assert e.store.read("relations").count() == before
    with pytest.raises(KeyError):
        e.impact("u", "nobody")
    with pytest.raises(ValueError):
        e.impact("u", "A服务", "sideways")
    with pytest.raises(ValueError):
        e.impact("u", "A服务", max_hops=9)


def test_feedback_states(make):
    e = make(correct_creates_pinned=False)
    m = e.remember("数据库使用 MySQL", "u")["id"]
    up = e.submit_feedback("u", "a1", "upvote", related_memory_ids=[m])
    weight = lambda: e.store.read("memories").where(F.col("id") == m).first()["weight"]
    assert up["status"] is None and weight() == pytest.approx(1.05)
    done = e.submit_feedback("u", "a2", "correct", correction_text="应该是 PostgreSQL 不是 MySQL", related_memory_ids=[m])
    assert done["status"] == "accepted" and weight() == pytest.approx(0.95)
    assert "正确事实：PostgreSQL（此前误为 MySQL）" in contents(e)
    assert e.recall("u", "PostgreSQL")[0]["content"].startswith("正确事实")
    down = e.submit_feedback("u", "a3", " Downvote ", related_memory_ids=[m])
    assert down["status"] == "accepted" and e.store.read("memories").where(F.col("id") == down["derived_memory_id"]).first()["memory_type"] == "negative"
    assert e.submit_feedback("u", "a4", "downvote")["status"] == "rejected_low_confidence"
    for kind, text in (("correct", "  "), ("shrug", None)):
        with pytest.raises(ValueError):
            e.submit_feedback("u", "a5", kind, correction_text=text)


def test_pending_feedback(make):
    e = make()
    f = e.submit_feedback("u", "a", "correct", correction_text="我叫 cc", wait=False)
    assert f["status"] == "pending"
    e.process_pending()
    done = e.get_feedback(f["id"])
    assert done["status"] == "accepted"
    row = e.store.read("memories").where(F.col("id") == done["derived_memory_id"]).first()
    assert row["pinned"] and row["memory_type"] == "identity" and row["source"] == "reflection"


def test_alerts(make):
    e = make(embedding_dim=128)
    old = e.remember("后端项目使用 Java Spring 服务", "u")["id"]
    told = e.remember("后端项目改用 Go 服务", "u")["alerts"]
    assert told[0]["type"] == "tech_stack_shift" and told[0]["memory_id"] == old and "java→go" in told[0]["message"]
    e2 = e.remember("后端项目改用 Go 服务", "u")["alerts"]
    assert all(a["type"] != "conflict" for a in e2)


def test_recommend(make):
    e = make(embedding_dim=128)
    e.remember("服务 timeout 的经验：调大 timeout 并重试", "u")
    e.remember("theme preference dark", "u", pinned=True)
    found = e.recommend("u", "timeout 服务 怎么办")
    assert found[0]["content"].startswith("服务 timeout")
    assert e.recommend("u", " ") == []


def test_consolidation(make):
    e = make(embedding_dim=128, cluster_similarity=0.2, forget_threshold=0.08)
    e.remember("数据库使用 MySQL 作为存储", "u")
    e.submit_feedback("u", "a", "correct", correction_text="应该是 PostgreSQL 不是 MySQL")
    (told,) = e.consolidate()
    assert told["conflicts_resolved"] == 1 and "数据库使用 MySQL 作为存储" not in contents(e)
    f = make(embedding_dim=128)
    f.store = type(e.store)(f.spark, e.store.root + "2")
    for t in ("数据库使用 sqlite 存储 a", "数据库使用 sqlite 存储 b", "数据库 sqlite 备份 c"):
        f.remember(t, "u")
    (told,) = f.consolidate()
    assert told["compressed_clusters"] == 1 and told["compressed_deleted"] == 3
    (summary,) = contents(f)
    assert summary.startswith("【精华摘要·database】") and summary.count("；") == 2
    assert f.store.read("embeddings").count() == 1


def test_reembed(make, spark):
    e = make(embedding_dim=64)
    e.remember("owned fact api", "u")
    e.remember("orphan fact api", None)
    stale = e.store.read("embeddings").select("memory_id", "user_id", F.lit("old").alias("model"), F.lit(32).alias("dim"), "vector", "created_at")
    ghost = spark.createDataFrame([("ghost", "u", "old", 32, [0.0], START)], "memory_id string, user_id string, model string, dim int, vector array<float>, created_at timestamp")
    e.store.commit({"embeddings": stale.unionByName(ghost)})
    told = e.reembed(dry_run=True, orphan_policy="assign", orphan_user="u")
    assert (told["reembedded"], told["dangling_removed"]) == (2, 1) and e.store.read("embeddings").count() == 3
    told = e.reembed(orphan_policy="assign", orphan_user="u")
    assert (told["reembedded"], told["orphans_assigned"], told["dangling_removed"]) == (2, 1, 1)
    again = e.reembed(orphan_policy="assign", orphan_user="u")
    assert (again["reembedded"], again["skipped"]) == (0, 2)
    e.remember("another orphan api", None)
    assert e.reembed(orphan_policy="skip")["orphans_skipped"] == 1
    with pytest.raises(ValueError):
        e.reembed(orphan_policy="fail")


def test_archive(make, tmp_path, spark):
    from mnemos.sources.archive import document, listing, sections

    e = make()
    e.remember("项目使用 FastAPI", "u")
    row = e.dump(f"file://{tmp_path}/l3", "u")
    assert len(row["checksum"]) == 64 and row["memory_count"] == 1 and "dump_20260729T000000Z_u.json" in row["uri"]
    assert [r["id"] for r in e.archives()] == [row["id"]] and listing(spark, f"file://{tmp_path}/l3").count() > 0
    doc = document(sections(e.store.read("memories"), e.store.read("entities"), e.store.read("relations"), "u"), START, "u").first()
    assert '"version" : 1' in doc["json"] and "FastAPI" in doc["json"] and len(doc["checksum"]) == 64


def test_tools_and_turns(make):
    from mnemos.turns import after_turn, before_turn, routed

    e = make()
    assert e.dispatch("remember", '{"content": "项目使用 redis", "user_id": "u"}')["ok"]
    assert e.dispatch("recall", {"user_id": "u", "query": "redis"})["result"][0]["content"] == "项目使用 redis"
    assert not e.dispatch("nothing")["ok"] and not e.dispatch("recall", "{")["ok"] and not e.dispatch("recall", {"user_id": "u", "query": "x", "top_k": 0})["ok"]
    turns = e.spark.createDataFrame([(1, "我叫 cc"), (2, "不对，应该是 3"), (3, "hi"), (4, "项目用 api"), (5, "改 A服务 会怎样")], "n long, user_text string")
    got = {r["n"]: (r["route"], r["memory_type"], r["entity"]) for r in routed(turns).collect()}
    assert got[1][:2] == ("remember", "identity") and got[2][0] == "correct" and got[3][0] == "none" and got[4][:2] == ("remember", "fact") and got[5][2] == "A服务"
    assert after_turn(e, "u", "我叫 cc", "a")["pinned"]
    assert "redis" in before_turn(e, "u", "redis 项目")["text"]


def test_store_versions(make, spark):
    from mnemos.schemas import SESSIONS

    e = make()
    rows = spark.createDataFrame([("s", None, "u", "open", "{}", START, None)], SESSIONS)
    assert e.store.commit({"sessions": rows}, batch="b") == 1
    assert e.store.commit({"sessions": rows.where("false")}, batch="b") == 1
    assert e.store.read("sessions").count() == 1
    e.store.upsert("sessions", rows.withColumn("status", F.lit("closed")))
    assert [r["status"] for r in e.store.read("sessions").collect()] == ["closed"]
    old = spark.createDataFrame([("m", "u", "text")], "id string, user_id string, content string")
    e.store.append("memories", old)
    row = e.store.read("memories").first()
    assert row["access_count"] == 0 and row["weight"] == 1.0
    assert e.store.truncate("memories") == 4 and e.store.read("memories").count() == 0


def test_two_writers_lose_no_commit(spark, tmp_path):
    from mnemos.sources.store import CommitConflict, SnapshotStore

    store, other = (SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    row = lambda i: spark.createDataFrame([(i,)], "id string")
    store.append("entities", row("a"))
    base = store.current()[0]
    other.append("entities", row("b"))
    with pytest.raises(CommitConflict):
        store.commit({"entities": store.read("entities")}, base=base)
    calls = []

    def change(df):
        calls.append(1)
        if len(calls) == 1:
            other.append("entities", row("c"))
        return df.unionByName(row("d"), allowMissingColumns=True)

    store.update("entities", change)
    (tmp_path / "s/_versions/00000099.json").write_text("")  # a writer died here
    store.append("entities", row("e"))
    assert sorted(r["id"] for r in store.read("entities").collect()) == list("abcde") and len(calls) == 2 and store.current()[0] == 100


def test_counters_of_consolidation_are_the_sums_of_its_reports(make):
    from mnemos.operators import consolidate

    e = make(embedding_dim=128)
    assert e.consolidate() == [] and e.snapshot()["consolidation_users"] == 0
    for user in ("u", "v"):
        for t in ("数据库使用 sqlite 存储 a", "数据库使用 sqlite 存储 b", "数据库 sqlite 备份 c"):
            e.remember(t, user)
    told = e.consolidate()
    schema = "user_id string, " + ", ".join(f"{c} long" for c in consolidate.COUNTERS)
    report = e.spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in told], schema)
    sums = consolidate.totals(report).first().asDict()
    assert sums["users"] == 2 and sums["compressed_deleted"] == 6 and sums["compressed_clusters"] == 2
    found = e.snapshot()
    assert {f"consolidation_{k}": v for k, v in sums.items()}.items() <= found.items()
    assert list(found) == sorted(found) and found["consolidations"] == 2 and found["memories_remembered"] == 6
    assert consolidate.totals(report.limit(0)).first().asDict() == dict.fromkeys(sums, 0)
    with pytest.raises(ValueError):
        e.entities("u", limit=0)
