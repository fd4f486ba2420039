"""The store: deltas, tombstones, versions, transactions of two writers, upkeep."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from mnemos.api import MemoryEngine
from mnemos.config import EngineConfig
from mnemos.schemas import conform
from mnemos.sources.store import CommitConflict, SnapshotStore, Transaction

START = datetime(2026, 7, 29, tzinfo=UTC)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4)


def names(spark, *rows):
    return conform(spark.createDataFrame([(i, n) for i, n in rows], "id string, name string"), "entities")


def content(store, **options):
    return {r["id"]: r["name"] for r in store.read("entities", **options).collect()}


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_deltas_and_tombstones_against_a_dict(spark, store):
    import random

    rnd, want = random.Random(3), {}
    states = {}
    for step in range(4):
        rows = {f"k{rnd.randrange(12)}": f"v{step}-{i}" for i in range(5)}
        gone = {f"k{rnd.randrange(14)}" for _ in range(2)}

        def work(own, rows=rows, gone=gone):
            own.upsert("entities", names(spark, *rows.items()))
            own.delete("entities", spark.createDataFrame([(g,) for g in gone], "id string"))

        store.transact(work)
        want = {k: v for k, v in (want | rows).items() if k not in gone}
        states[store.current()[0]] = want
        assert content(store) == want
    assert all(content(store, version=v) == w for v, w in states.items())
    assert content(store, keys=["k1", "k5", "nobody"]) == {k: v for k, v in want.items() if k in ("k1", "k5")}
    parts = len(store.current()[1]["entities"])
    assert store.maintain(most_parts=parts - 1) == ["entities"] and len(store.current()[1]["entities"]) == 1
    assert content(store) == want and content(store, version=max(states)) == want


def test_bytes_follow_the_change(spark, store, tmp_path):
    many = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    store.upsert("entities", conform(many, "entities"))
    before = size(tmp_path / "s/entities")
    store.upsert("entities", names(spark, ("k7", "new")))
    store.delete("entities", spark.createDataFrame([("k8",), ("nobody",)], "id string"))
    assert size(tmp_path / "s/entities") - before < before / 100
    assert store.read("entities").count() == 199_999 and content(store, keys=["k7", "k8"]) == {"k7": "new"}
    # A lookup opens only the bucket of its key.
    plan = store.read("entities", keys=["k123"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_delete_tells_how_many(spark, store):
    store.upsert("entities", names(spark, ("a", "1"), ("b", "2")))
    assert store.delete("entities", spark.createDataFrame([("a",), ("a",), ("c",)], "id string")) == 1
    assert store.delete("entities", spark.createDataFrame([("a",)], "id string")) == 0


def test_put_writes_the_difference(spark, store):
    store.upsert("entities", names(spark, ("a", "1"), ("b", "2"), ("c", "3")))
    store.update("entities", lambda df: df.where("id <> 'a'").withColumn("name", F.when(F.col("id") == "b", "new").otherwise(F.col("name"))))
    assert content(store) == {"b": "new", "c": "3"}
    assert [p["rows"] for p in store.current()[1]["entities"]] == [3, 1, 1]


def test_transactions_of_two_writers(spark, store):
    store.upsert("entities", names(spark, ("a", "1")))
    reader, blind, other = Transaction(store), Transaction(store), Transaction(store)
    reader.upsert("entities", reader.read("entities").withColumn("name", F.lit("2")))
    blind.upsert("entities", names(spark, ("b", "1")))
    other.upsert("sessions", spark.createDataFrame([("s", "open")], "id string, status string"))
    other.read("sessions")
    blind.commit()  # nothing read: goes on top of whatever there is
    other.commit()  # read a table that nobody has changed
    with pytest.raises(CommitConflict):
        reader.commit()
    assert content(store) == {"a": "1", "b": "1"} and store.read("sessions").count() == 1
    tries = []

    def work(own):
        rows = own.read("entities").where("id = 'a'")
        if not tries:
            store.upsert("entities", names(spark, ("a", "3")))
        tries.append(1)
        own.upsert("entities", rows.withColumn("name", F.concat("name", F.lit("!"))))

    store.transact(work)
    assert content(store)["a"] == "3!" and len(tries) == 2


def test_batches_survive_expiry(spark, store, tmp_path):
    for i in range(4):
        store.transact(lambda own, i=i: own.upsert("entities", names(spark, (f"k{i}", "x"))), batch=f"b{i}")
    store.compact("entities")
    old = store.current()[0]
    store.upsert("entities", names(spark, ("more", "x")))
    assert store.expire(keep=2, grace_ms=-1) == 4 and store.applied("b0") and not store.applied("b9")
    with pytest.raises(KeyError):
        store.read("entities", version=1)
    assert store.read("entities", version=old).count() == 4 and store.read("entities").count() == 5
    assert len(list((tmp_path / "s/entities").iterdir())) == 2
    store.transact(lambda own: own.upsert("entities", names(spark, ("k0", "again"))), batch="b0")
    assert content(store)["k0"] == "x"


def test_two_engines_lose_no_rows(spark, tmp_path):
    config = EngineConfig(embedding_dim=16, min_score=0.0, min_score_no_lexical=0.0, extract_on_remember=False, alerts_enabled=False)
    a, b = (MemoryEngine(spark, f"file://{tmp_path}/s", config, lambda: START) for _ in range(2))
    first = a.remember("the first fact about api", "u")["id"]
    seen = []
    decide = a.store.transact

    def interrupted(work, **options):
        """Between a's reads and its commit, b writes."""

        def later(own):
            out = work(own)
            if len(seen) < 2:
                seen.append(b.remember(f"from the other engine {len(seen)}", "u")["id"])
            return out

        return decide(later, **options)

    a.store.transact = interrupted
    assert a.pin(first)["pinned"]
    second = a.remember("the second fact about api", "u")["id"]
    a.consolidate()
    rows = {r["id"]: r["pinned"] for r in b.store.read("memories").where("deleted_at IS NULL OR source = 'consolidation'").collect()}
    everything = {r["id"] for r in b.store.read("memories").collect()}
    assert {first, second, *seen} <= everything and rows[first] and len(seen) == 2


def test_checksum_follows_every_byte(spark, tmp_path):
    from mnemos.sources import archive

    rows = conform(spark.createDataFrame([(f"e{i}", f"name {i % 3}") for i in range(40)], "id string, name string"), "entities")
    none = {k: spark.createDataFrame([], t) for k, t in (("memories", "id string, deleted_at timestamp"), ("relations", "id string, deleted_at timestamp"))}
    dump = lambda df, name: archive.dump(spark, archive.sections(none["memories"], df, none["relations"]), f"file://{tmp_path}/{name}", START).first()
    first, again = dump(rows, "a"), dump(rows, "b")
    assert first["checksum"] == again["checksum"] == archive.checksum(spark, first["uri"]) and first["entity_count"] == 40
    header = spark.read.text(f"{first['uri']}/section=header").first()[0]
    assert 'version' in header and "2026-07-29T00:00:00Z" in header
    doubled = rows.unionByName(rows.where("id = 'e1'")).unionByName(rows.where("id = 'e1'"))
    swapped = rows.withColumn("name", F.when(F.col("id") == "e1", "name 2").when(F.col("id") == "e2", "name 1").otherwise(F.col("name")))
    assert len({first["checksum"], dump(doubled, "c")["checksum"], dump(swapped, "d")["checksum"]}) == 3
    (file,) = [f for f in (tmp_path / "a").rglob("section=entities/*.json")][:1]
    text = file.read_text().splitlines()
    file.write_text("\n".join([text[1], text[0], *text[2:]]) + "\n")
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert archive.checksum(spark, first["uri"]) != first["checksum"]


def test_reembedding_goes_on_where_it_stopped(spark, tmp_path):
    from mnemos.functions.vector import hash_embed
    from mnemos.operators import migrate

    rows = conform(spark.createDataFrame([(f"m{i}", None if i % 5 == 0 else "u", f"text {i}") for i in range(20)], "id string, user_id string, content string"), "memories")
    old = conform(spark.createDataFrame([(f"m{i}", "u", "old", 8, [0.0] * 8) for i in range(10)] + [("ghost", "u", "hashing", 16, [0.0] * 16)], "memory_id string, user_id string, model string, dim int, vector array<float>"), "embeddings")
    config, now, options = EngineConfig(embedding_dim=16), F.lit(START).cast("timestamp"), {"orphan_policy": "assign", "orphan_user": "u"}
    stores = [SnapshotStore(spark, f"file://{tmp_path}/{n}") for n in "ab"]
    for s in stores:
        s.upsert("memories", rows)
        s.upsert("embeddings", old)
    seen = []

    def embed(df, id_col, text_col, dim):
        seen.append(sorted(r[0] for r in df.select(id_col).collect()))
        if len(seen) == 3:
            raise OSError("killed")
        return hash_embed(df, id_col, text_col, dim)

    run = lambda **more: migrate.reembed_in_parts(stores[0], now, "r", config, part_rows=5, embed=embed, **options, **more)
    assert not run(most_parts=1, recreate=True)["finished"] and stores[0].read("embeddings").select("dim").distinct().count() == 1
    with pytest.raises(OSError):
        run()
    told = run()
    assert told == {"reembedded": 20, "orphans_assigned": 4, "dangling_removed": 1, "finished": True}
    assert sorted(x for k, part in enumerate(seen) if k != 2 for x in part) == sorted(f"m{i}" for i in range(20)) and seen[2] == seen[3]
    assert run() == told and len(seen) == 5
    _, vectors, report = migrate.reembed(stores[1].read("memories"), stores[1].read("embeddings"), now, config, **options)
    show = lambda df: sorted((r["memory_id"], r["user_id"], r["model"], tuple(r["vector"])) for r in df.collect())
    assert show(stores[0].read("embeddings")) == show(vectors) and report.first()["reembedded"] == 20
