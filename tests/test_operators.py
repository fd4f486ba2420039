"""Operators against plain loops, streams against batches."""

import json
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemos.config import EngineConfig
from mnemos.functions import vector
from mnemos.operators import changes, consolidate, graph, ingest, lookup
from mnemos.sources import readers
from mnemos.sources.store import SnapshotStore
from mnemos.streaming import jobs

NOW = datetime(2026, 7, 29)
MEM = "id string, user_id string, tenant_id string, content string, memory_type string, importance double, weight double, pinned boolean, source string, access_count int, created_at timestamp, updated_at timestamp, last_accessed_at timestamp, deleted_at timestamp, decay_lambda double"


def memory(i, user="u", content="x", kind="fact", weight=1.0, pinned=False, source="ingest", deleted=None, importance=0.5):
    at = datetime(2026, 7, 1, i % 24)
    return (f"m{i}", user, None, content, kind, importance, weight, pinned, source, 0, at, at, None, deleted, None)


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "heads": 3}, {"block": 25, "heads": 100}])
def test_star_clusters_against_a_loop(spark, sizes):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        vector = [rnd.choice([0.0, 1.0]) for _ in range(6)]
        rows.append((f"u{i % 2}", f"m{i}", i // 2, " ".join(rnd.sample(words, 4)), vector))
    config = EngineConfig(cluster_similarity=0.75, cluster_overlap=0.3, max_clusters=4)
    df = spark.createDataFrame(rows, "user_id string, id string, place long, content string, vector array<double>")
    got = {r["id"]: r["cluster"] for r in consolidate.star_clusters(df, config, **sizes).collect()}

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    want = {}
    for user in ("u0", "u1"):
        own = [r for r in rows if r[0] == user]
        used, made = set(), 0
        for i, a in enumerate(own):
            if i in used or made == 4:
                continue
            star = [j for j in range(i + 1, len(own)) if j not in used and (cos(a[4], own[j][4]) >= 0.75 - 1e-12 or len(set(a[3].split()) & set(own[j][3].split())) / len(set(a[3].split()) | set(own[j][3].split())) >= 0.3)]
            if len(star) + 1 >= 3:
                for j in [i, *star]:
                    used.add(j)
                    want[own[j][1]] = a[2]
                made += 1
    assert got == want and want


def test_mixed_deltas_against_a_loop(spark):
    rnd = random.Random(1)
    m = spark.createDataFrame([memory(i, weight=rnd.uniform(0.05, 3)) for i in range(5)], MEM)
    deltas = [(f"m{rnd.randrange(6)}", i, rnd.choice([0.05, -0.1, 2.0, -2.0])) for i in range(60)]
    got = {r["id"]: r["weight"] for r in changes.adjust_weights(m, spark.createDataFrame(deltas, "id string, seq long, delta double")).collect()}
    for r in m.collect():
        w = r["weight"]
        for name, _, d in deltas:
            if name == r["id"]:
                w = min(3.0, max(0.05, w + d))
        assert got[r["id"]] == pytest.approx(w)


def test_folded_steps_are_the_loop(spark, monkeypatch):
    """Many events of one memory over many parts, put together three at a time."""
    monkeypatch.setattr(changes, "FOLD", 3)
    rnd = random.Random(8)
    m = spark.createDataFrame([memory(1), memory(2, weight=2.5), memory(3, deleted=NOW)], MEM)
    deltas = [("m1", i, rnd.uniform(-1.5, 1.4)) for i in range(700)] + [("m2", 1, 0.4), ("m2", 0, 5.0), ("m2", 2, 0.0), ("m3", 0, 1.0), ("none", 0, 1.0)]
    rnd.shuffle(deltas)
    got = {r["id"]: r["weight"] for r in changes.adjust_weights(m, spark.createDataFrame(deltas, "id string, seq long, delta double").repartition(9)).collect()}
    w = 1.0
    for _, _, d in sorted(x for x in deltas if x[0] == "m1"):
        w = min(3.0, max(0.05, w + d))
    assert got["m1"] == pytest.approx(w) and got["m2"] == 3.0 and got["m3"] == 1.0


def clustered_vectors():
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(f"m{i}", "hot" if i % 4 else f"u{i % 3}", [x + rnd.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(900)]
    odd = [("z1", "hot", [0.0] * 8), ("z2", "hot", [1.0, 2.0]), ("z3", "hot", None), ("same1", "hot", centres[0]), ("same2", "hot", centres[0]), ("far", "lone", [1.0, 2.0])]
    queries = [(i, "hot" if i % 2 else "u1", [x + rnd.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(20)]
    queries += [(90, "hot", [0.0] * 8), (91, "hot", [1.0, 2.0]), (92, "nobody", centres[0]), (93, "lone", centres[0]), (94, "hot", centres[0])]
    return rows + odd, queries


@pytest.mark.parametrize("pivots,k", [(12, 5), (1, 7), (40, 400)])
def test_index_finds_what_a_scan_finds(spark, pivots, k):
    from mnemos.functions.vector import nearest
    from mnemos.operators.index import VectorIndex

    rows, queries = clustered_vectors()
    v = spark.createDataFrame(rows, "memory_id string, user_id string, vector array<double>")
    q = spark.createDataFrame(queries, "query_id long, user_id string, vector array<double>")
    index = VectorIndex.build(v, pivots=pivots)
    show = lambda df: sorted((r["query_id"], r["rank"], r["memory_id"], r["similarity"]) for r in df.collect())
    assert show(index.search(q, k)) == show(nearest(q, v, k))
    if pivots == 12:
        assert index.scored_share(q.where("query_id < 20"), k) < 0.25


def test_index_of_nothing(spark):
    from mnemos.operators.index import VectorIndex

    v = spark.createDataFrame([], "memory_id string, user_id string, vector array<double>")
    q = spark.createDataFrame([(1, "u", [1.0])], "query_id long, user_id string, vector array<double>")
    assert VectorIndex.build(v).search(q, 3).count() == 0
    some = spark.createDataFrame([("a", "u", None), ("b", "u", [])], v.schema)
    assert VectorIndex.build(some).search(q, 3).count() == 0


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    from mnemos.operators.trigrams import TrigramIndex

    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("abcß中 ") for _ in range(rnd.randrange(0, 30)))) for i in range(200)] + [(200, None), (201, ""), (202, "a" * 5000), (202, "twice b")]
    needles = {"", "a", "ab", "中", "ßa", "abc", "zzz", "aaaa", " b", "a" * 4000, *(t[2:9] for _, t in texts[:40])}
    df = spark.createDataFrame(texts, "n long, body string")
    asked = spark.createDataFrame([(x,) for x in [*needles, None, "a"]], "needle string")
    want = sorted((x, i) for x in needles for i, t in texts if t is not None and x in t)
    for path in (None, f"file://{tmp_path}/index"):
        index = TrigramIndex.build(df, "n", F.col("body"), path)
        assert sorted((r["needle"], r["id"]) for r in index.containing(asked).collect()) == want
    # The rarest trigram alone gives the candidates, and only their folders are opened.
    one = asked.where("needle = 'zzz'")
    assert index.candidates(one).isEmpty() and index.containing(one).isEmpty()
    lone = [x for x in needles if sum(t is not None and x in t for _, t in texts) == 1 and len(x) == 7][0]
    found = index.containing(asked.where(F.col("needle") == lone))
    assert found.count() == 1
    assert len({f.split("folder=")[1].split("/")[0] for f in index.texts.inputFiles()}) > 20
    scan = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert scan and all("folder#" in x.split("PartitionFilters: [")[1] for x in scan)
    assert TrigramIndex.build(df.where("false"), "n", F.col("body")).containing(asked).isEmpty()


def test_paths_of_five_hops(spark):
    """Simple paths against a walk, over a graph with cycles and a hub."""
    rnd = random.Random(2)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(9), rnd.randrange(9)) for _ in range(22)) if a != b} | {(0, i) for i in range(1, 9)})
    steps = spark.createDataFrame([("u", str(a), (str(b),), f"{a}>{b}") for a, b in pairs], "user_id string, src string, node struct<id: string>, edge string")
    seeds = spark.createDataFrame([(0, "u", ("0",)), (1, "u", ("4",))], "seed_id long, user_id string, node struct<id: string>")

    def walk(nodes, left):
        for a, b in pairs:
            if str(a) == nodes[-1] and str(b) not in nodes:
                yield (*nodes, str(b))
                if left > 1:
                    yield from walk((*nodes, str(b)), left - 1)

    for hops in (2, 5):
        found = [(r["seed_id"], r["hops"], tuple(n["id"] for n in r["nodes"])) for r in graph.paths(seeds, steps, hops).collect()]
        want = [(s, len(p) - 1, p) for s, start in ((0, "0"), (1, "4")) for p in walk((start,), hops)]
        assert sorted(found) == sorted(want)
    front = graph.paths(seeds, steps, 5)
    assert front._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5


def test_paths_through_a_wide_node_come_from_many_tasks(spark):
    """At larger sizes nothing is broadcast; all paths through a hub came from the one task that has its key."""
    n, seeded = 8_000, 20
    ends = [("u", "hub", (str(i),), f"hub>{i}") for i in range(n)] + [("u", str(i), ("hub",), f"{i}>hub") for i in range(n)]
    steps = spark.createDataFrame(ends, "user_id string, src string, node struct<id: string>, edge string")
    seeds = spark.createDataFrame([(i, "u", (str(i),)) for i in range(seeded)], "seed_id long, user_id string, node struct<id: string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = graph.paths(seeds, steps, 2).select("seed_id", "hops", F.array_join("nodes.id", " ").alias("path"), F.array_join("edges", " ").alias("edges"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(s, 1, f"{s} hub", f"{s}>hub") for s in range(seeded)] + [(s, 2, f"{s} hub {i}", f"{s}>hub hub>{i}") for s in range(seeded) for i in range(n) if i != s]
    assert sorted((r["seed_id"], r["hops"], r["path"], r["edges"]) for r in rows) == sorted(want)
    tasks = Counter(r["task"] for r in rows)
    assert max(tasks.values()) <= 0.7 * len(rows), tasks


def test_steps_of_wide_nodes_are_dealt_once_for_all_hops(spark):
    """Two hops make three joins with the steps; those of the first hop were dealt apart, as a filter was added to them."""
    ends = [("u", "hub", (str(i),), f"hub>{i}") for i in range(1_500)] + [("u", str(i), ("hub",), f"{i}>hub") for i in range(1_500)]
    steps = spark.createDataFrame(ends, "user_id string, src string, node struct<id: string>, edge string")
    seeds = spark.createDataFrame([(0, "u", ("0",))], "seed_id long, user_id string, node struct<id: string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.paths(seeds, steps, 2)
        assert len(found.collect()) == 1_500
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The rows that go through each exchange of parts: fronts of both hops, and the steps.
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len([line for line in dealt if "Reused" not in line]) == 3 and len([line for line in dealt if "Reused" in line]) == 3, plan


def test_soft_delete_spares_pinned_and_deleted(spark):
    m = spark.createDataFrame([memory(1, pinned=True), memory(2), memory(3, deleted=datetime(2026, 1, 1)), memory(4)], MEM)
    ids = spark.createDataFrame([("m1",), ("m2",), ("m2",), ("m3",), ("none",)], "id string")
    after = changes.soft_delete(m, ids, F.lit(NOW).cast("timestamp"))
    assert {r["id"]: r["changed"] for r in after.collect()} == {"m1": False, "m2": True, "m3": False, "m4": False}


def test_lookup_order_and_repeats(spark):
    m = spark.createDataFrame([memory(1), memory(2, deleted=NOW)], MEM)
    q = spark.createDataFrame([(0, ["m2", "no", "m1", "m2"])], "query_id long, ids array<string>")
    assert [r["id"] for r in lookup.by_ids(q, m).orderBy("pos").collect()] == ["m2", "m1", "m2"]


def test_conflict_rules(spark):
    at = lambda a, b, t: spark.range(1).select(consolidate.topic_conflict(F.lit(a), F.lit(b), F.lit(t)).alias("v")).first()["v"]
    assert at("use MySQL", "use sqlite", "database") and not at("postgres", "PostgreSQL", "database") and not at("redis", "mysql", "database")
    assert at("spring", "go now", "backend_lang") and not at("java", "Spring", "backend_lang")
    assert at("登录 用 jwt 方式", "登录 不是 jwt 方式", "auth") and not at("登录 用 jwt", "登录 用 jwt", "auth")


def test_conflict_winner_order(spark):
    rows = [memory(1, content="mysql", weight=2.0), memory(2, content="sqlite", source="reflection"), memory(3, content="mongodb", pinned=True), memory(4, content="mysql", user="v")]
    got = {(r["winner"], r["loser"]) for r in consolidate.conflicts(spark.createDataFrame(rows, MEM)).collect()}
    assert got == {("m3", "m1"), ("m3", "m2")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A depends on B and C; x", [("A", "B"), ("A", "C")]),
        ("甲服务依赖于乙服务", [("甲服务", "乙服务")]),
        ("P uses　Sand, Land/了K", [("P", "Sand"), ("P", "Land"), ("P", "K")]),
        ("T属于的X项目的；", [("T", "X项目")]),
        ("nothing", []),
    ],
)
def test_extraction(spark, text, want):
    df = spark.createDataFrame([("t", text)], "id string, text string")
    assert [(r["from_name"], r["to_name"]) for r in graph.extract_relations(df).orderBy("ord").collect()] == want


def test_paths_are_simple(spark):
    rnd = random.Random(9)
    edges = {(rnd.randrange(7), rnd.randrange(7)) for _ in range(16)}
    edges = {(a, b) for a, b in edges if a != b}
    steps = spark.createDataFrame([("u", str(a), (str(b),), (f"{a}>{b}",)) for a, b in edges], "user_id string, src string, node struct<id: string>, edge struct<id: string>")
    seeds = spark.createDataFrame([(i, "u", (str(i),)) for i in range(7)], "seed_id long, user_id string, node struct<id: string>")
    rows = graph.paths(seeds, steps, 3).collect()
    got = {tuple(n["id"] for n in r["nodes"]) for r in rows}
    assert all([e["id"] for e in r["edges"]] == [f"{a['id']}>{b['id']}" for a, b in zip(r["nodes"], r["nodes"][1:], strict=False)] and r["hops"] == len(r["edges"]) for r in rows)
    want = set()
    front = [(str(i),) for i in range(7)]
    for _ in range(3):
        front = [(*p, str(b)) for p in front for a, b in edges if str(a) == p[-1] and str(b) not in p]
        want |= set(front)
    assert got == want


def test_entity_upsert_keeps_aliases(spark):
    base = spark.createDataFrame([("e1", None, "u", "Redis", "other", ["缓存"], "{}", NOW, NOW)], "id string, tenant_id string, user_id string, name string, entity_type string, aliases array<string>, meta_json string, created_at timestamp, updated_at timestamp")
    found = spark.createDataFrame([("u", None, " 缓 存", "tech", ["r"], 1), ("u", None, "new one", "", [], 2), ("v", None, "redis", "tech", [], 3)], "user_id string, tenant_id string, name string, entity_type string, aliases array<string>, ord long")
    rows = {(r["user_id"], r["name"]): (r["id"], r["entity_type"], r["aliases"]) for r in graph.upsert_entities(base, found, F.lit(NOW).cast("timestamp")).collect()}
    assert rows[("u", "Redis")] == ("e1", "tech", ["r", "缓存"]) and rows[("u", "new one")][1] == "other" and rows[("v", "redis")][1] == "tech"


def test_batch_equals_single_calls(spark):
    rows = [(i, f"api fact {i}", "u", None, None, "fact", 0.5, False) for i in range(5)]
    schema = "ord long, content string, user_id string, tenant_id string, session_id string, memory_type string, importance double, pinned boolean"
    at = F.lit(NOW).cast("timestamp")
    together = {tuple(r) for r in ingest.flagged(spark.createDataFrame(rows, schema), at).collect()}
    apart = {tuple(ingest.flagged(spark.createDataFrame([r], schema), at).first()) for r in rows}
    assert together == apart


def test_exchange_formats(spark, tmp_path):
    values = spark.createDataFrame([('{"id": "a", "session_id": "s", "content": "c"}', 0)], "value string, seq long")
    item = readers.l1_from_json(values).first()
    assert item["importance"] == 0.5 and item["memory_type"] == "fact" and item["pinned"] is False
    assert json.loads(readers.l1_to_json(readers.l1_from_json(values)).first()["value"])["content"] == "c"
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "c1", "suite": "s", "steps": [{"op": "remember", "content": "x", "pinned": True}]}]))
    case = readers.eval_cases(spark, f"file://{tmp_path}/cases.json").first()
    assert case["steps"][0]["op"] == "remember" and case["steps"][0]["pinned"]


EVENT = {"user_id": "u", "answer_id": "a", "related_memory_ids": ["m1"], "created_at": "2026-07-29T00:00:00Z"}


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [{"id": "f1", "feedback_type": "upvote"} | EVENT, {"id": "f2", "feedback_type": "correct", "correction_text": "应该是 A 不是 B"} | EVENT, {"id": "f3", "feedback_type": "bad"} | EVENT]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(r) for r in rows))
    stores = []
    for name in ("stream", "batch"):
        store = SnapshotStore(spark, f"file://{tmp_path}/{name}")
        store.append("memories", spark.createDataFrame([memory(1)], MEM))
        stores.append(store)
    config = EngineConfig(embedding_dim=16)
    jobs.feedback_stream(spark, f"file://{tmp_path}/in", stores[0], f"file://{tmp_path}/cp", NOW, config).awaitTermination(120)
    jobs.apply_feedback(stores[1], spark.read.schema(jobs.FEEDBACK_EVENTS).json(f"file://{tmp_path}/in"), NOW, config, batch="feedback-0")
    jobs.apply_feedback(stores[1], spark.read.schema(jobs.FEEDBACK_EVENTS).json(f"file://{tmp_path}/in"), NOW, config, batch="feedback-0")
    for table in ("memories", "reflection_records", "feedback_events", "embeddings"):
        a, b = (sorted(map(str, s.read(table).collect())) for s in stores)
        assert a == b and a
    assert stores[0].read("memories").where("id = 'm1'").first()["weight"] == pytest.approx(0.95)


def test_feedback_is_applied_once_and_bad_events_are_kept(spark, tmp_path):
    """The writer dies before the pointer is made; the same batch comes again, at another time."""
    from pyspark.errors import StreamingQueryException

    (tmp_path / "in").mkdir()
    rows = [{"id": "f1", "feedback_type": "upvote"} | EVENT, {"id": "f3", "feedback_type": "bad"} | EVENT]
    (tmp_path / "in/1.json").write_text("\n".join([*map(json.dumps, rows), "{not json"]))
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.append("memories", spark.createDataFrame([memory(1)], MEM))
    times, make = iter([NOW, datetime(2026, 7, 30)]), store.point

    def die(*args):
        store.point = make
        raise OSError("killed")

    store.point = die
    start = lambda: jobs.feedback_stream(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp", lambda: next(times), EngineConfig(embedding_dim=16))
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    assert store.read("feedback_events").isEmpty() and store.read("memories").first()["weight"] == 1.0
    start().awaitTermination(120)
    start().awaitTermination(120)
    assert store.read("memories").first()["weight"] == pytest.approx(1.05)
    failed = {r["id"]: (r["problem"], r["created_at"]) for r in store.read("feedback_failed").collect()}
    assert len(failed) == 2 and failed["f3"] == ("unknown feedback type", datetime(2026, 7, 30))
    assert store.applied("feedback-0")


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    item = lambda i, imp, pinned=False: {"session_id": "s", "kind": "item", "id": f"i{i}", "content": f"c{i}", "importance": imp, "weight": 1.0, "pinned": pinned, "created_at": "2026-07-29T00:00:00Z"}
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(x) for x in [item(1, 0.9), item(2, 0.1), item(3, 0.2, True), item(4, 0.05), {"session_id": "t", "kind": "close"}]))
    (tmp_path / "in/2.json").write_text(json.dumps({"session_id": "s", "kind": "close"}))
    events = spark.readStream.schema(jobs.SESSION_EVENT).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    out = jobs.session_stream(events, NOW, EngineConfig(l1_max_items=3))
    out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    assert {r["id"]: r["promoted"] for r in spark.table("closed").collect()} == {"i1": True, "i2": False, "i3": True}


def test_session_stream_equals_batch_after_restart_with_late_items_and_timeouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng, config = random.Random(5), EngineConfig(l1_max_items=4)
    at = lambda minute: f"2026-07-29T{minute // 60:02d}:{minute % 60:02d}:00Z"

    def item(n, session, minute):
        return {"session_id": session, "kind": "item", "id": f"i{n}", "content": f"c{n}", "importance": rng.choice([0.1, 0.3, 0.6, 0.9]), "weight": rng.choice([1.0, 2.0]), "pinned": rng.random() < 0.2, "created_at": at(minute), "seq": n}

    def play(name, rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
        events = spark.readStream.schema(jobs.SESSION_EVENT).json(f"file://{tmp_path}/in")
        out = jobs.session_stream(events, config=config, timeout_ms=3_600_000, delay="10 minutes")
        writer = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp")
        writer.trigger(availableNow=True).start().awaitTermination(180)

    first = [item(n, rng.choice("ab"), rng.randrange(30)) for n in range(20)]
    second = [item(20 + n, rng.choice("ab"), 25 + rng.randrange(10)) for n in range(10)]
    lost = item(30, "a", 1)
    play(1, first)
    play(2, [*second, lost, {"session_id": None, "kind": "item", "id": "x", "created_at": at(30)}, {"session_id": "c", "kind": "close", "created_at": at(31)}])
    play(3, [{"session_id": "a", "kind": "close", "created_at": at(40)}])
    play(4, [item(31, "d", 300)])
    got = {r["id"]: (r["session_id"], r["promoted"], round(r["score"], 9), r["closed_at"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    last = max(int(r["created_at"][14:16]) for r in first + second if r["session_id"] == "b")
    closed = {"a": datetime(2026, 7, 29, 0, 40), "b": datetime(2026, 7, 29, 1, last)}
    rows = [(r["session_id"], r["id"], r["content"], r["importance"], r["weight"], r["pinned"], datetime.fromisoformat(r["created_at"]), r["seq"], closed[r["session_id"]]) for r in first + second]
    items = spark.createDataFrame(rows, "session_id string, id string, content string, importance double, weight double, pinned boolean, created_at timestamp, seq long, closed_at timestamp")
    batch = ingest.promotion(changes.evict(items, 4).where("kept"), F.col("closed_at"), config)
    assert got == {r["id"]: (r["session_id"], r["promoted"], round(r["score"], 9), r["closed_at"]) for r in batch.collect()}
    assert len(got) == 8


def test_nearest_in_blocks(spark, monkeypatch):
    """Blocks of few vectors give what pairs give: ties, copies, vectors without length, of other sizes, null."""
    monkeypatch.setattr(vector, "BLOCK_NUMBERS", 24)
    monkeypatch.setattr(vector, "TILE_NUMBERS", 16)
    own = [[float((i * k) % 7 - 3) for k in (1, 2, 3)] for i in range(30)] + [[0.0, 0.0, 0.0], [1.0, 2.0], None, [float("nan"), 1.0, 0.0]]
    v = spark.createDataFrame([("u" if i % 3 else "w", f"m{i}", x) for i, x in enumerate(own)], "user_id string, memory_id string, vector array<double>")
    q = v.selectExpr("user_id", "memory_id AS query_id", "vector")
    show = lambda df: sorted((r["query_id"], r["rank"], r["memory_id"], repr(r["similarity"])) for r in df.collect())
    assert show(vector.nearest(q, v, 4)) == show(vector.nearest(q, v, F.lit(4)))
    assert "FlatMapCoGroupsInArrow" in vector.nearest(q, v, 4)._jdf.queryExecution().toString()


def test_names_are_dealt_before_they_are_sorted(spark):
    """One file of texts isn't sorted by one task, and a name of all texts is one row before names are looked up."""
    texts = spark.createDataFrame([(f"t{i}", f"part{i} uses redis;") for i in range(50)], "id string, text string").coalesce(1)
    found = graph.extract_entities(graph.extract_relations(texts))
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert "REPARTITION_BY_COL" in "".join(plan) and found.count() == 100
    rows = found.selectExpr("'u' AS user_id", "CAST(NULL AS STRING) AS tenant_id", "name", "entity_type", "CAST(array() AS array<string>) AS aliases", "id AS ord")
    columns = "id string, tenant_id string, user_id string, name string, entity_type string, aliases array<string>, meta_json string, created_at timestamp, updated_at timestamp"
    base = spark.createDataFrame([("e1", None, "u", "Redis", "other", ["R"], "{}", None, None)], columns)
    out = {r["name"]: (r["id"], r["entity_type"], r["aliases"]) for r in graph.upsert_entities(base, rows, F.current_timestamp()).collect()}
    assert len(out) == 51 and out["Redis"] == ("e1", "tech", ["R"])


def test_hit_score_of_odd_rows(spark):
    """Keys are searched over batches in Python; nulls and empty lists count as before."""
    from mnemos.functions.text import hit_score

    rows = [(["ab", "xy", None, "ü"], "zABü"), ([], "a"), (None, "a"), (["a"], None), (["", "a"], "")]
    out = spark.createDataFrame(rows, "k array<string>, t string").select(hit_score(F.col("k"), F.col("t")).alias("s"))
    assert [r["s"] for r in out.collect()] == [0.5, 0.0, None, 0.0, 0.5]
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()


def test_star_clusters_find_frequent_stars_without_all_pairs(spark, monkeypatch):
    """A user whose first heads give all stars needs no comparison of all pairs of blocks; one with rare stars does, and gets the same."""
    from mnemos.operators import stars

    rows = [("u", f"m{i}", i, f"a{i % 5} b{i % 5}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, id string, place long, content string, vector array<double>")
    pairs, used = stars._leaders, []
    monkeypatch.setattr(stars, "_leaders", lambda *a: used.append(1) or pairs(*a))
    got = {r["id"]: r["cluster"] for r in consolidate.star_clusters(df, EngineConfig(max_clusters=4), block=10, heads=8).collect()}
    assert got == {f"m{i}": i % 5 for i in range(60) if i % 5 < 4} and not used
    # Lone rows first: no star within the first heads.
    late = df.withColumn("content", F.when(F.col("place") < 40, F.concat(F.lit("x"), "place")).otherwise(F.col("content")))
    got = {r["id"]: r["cluster"] for r in consolidate.star_clusters(late, EngineConfig(max_clusters=4), block=10, heads=8).collect()}
    assert got == {f"m{i}": 40 + i % 5 for i in range(40, 60) if i % 5 < 4} and used


def test_near_duplicates_shuffle_texts_and_no_tokens(spark, tmp_path):
    """Documents meet their neighbours as texts alone; what Python cuts is what the tokens are, odd white space and null texts too."""
    from mnemos.plans import QUERIES

    texts = ["red small ring", "red small\x85ring", "red small ring extra words", None, "数据库连接，红色", "数据库连接 红色", "a\x1cb cd", "cd a b", "", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["near_duplicate_pairs"](spark, str(tmp_path))
    assert {r["doc_id"]: r["near_duplicate"] for r in out.collect()} == {0: True, 1: False, 2: None, 3: None, 4: True, 5: False, 6: False, 7: False, 8: False}
    assert "split(" not in out._jdf.queryExecution().executedPlan().toString()


def test_postings_are_lists(spark):
    """A trigram of many texts of a slice is one row, not one for each text."""
    from mnemos.operators.trigrams import TrigramIndex

    texts = [(f"k{i}", f"same words {i}") for i in range(100)]
    index = TrigramIndex.build(spark.createDataFrame(texts, "k string, body string").coalesce(1), "k", F.col("body"))
    rows = [r for r in index.postings.collect() if r["gram"] == "wor"]
    assert len(rows) == 1 and sorted(rows[0]["ids"]) == sorted(k for k, _ in texts)
    assert index.sizes.where("gram = 'wor'").first()["n"] == 100
