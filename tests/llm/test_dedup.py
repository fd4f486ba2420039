"""Lines, exact and near duplicates, shards: against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemos.llm import exact_dedup, line_dedup, near_dedup, sharding
from mnemos.llm.common import words


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:]


def brute_all_earlier(rows, least):
    """Texts without lines that are within one edit of any earlier line, dropped or not."""
    seen, out = [], []
    for _, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            drop = len(line) >= least and any(within_one(line, x) for x in seen)
            if len(line) >= least:
                seen.append(line)
            if not drop:
                kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def variant(rnd, line):
    i = rnd.randrange(len(line) + 1)
    kind = rnd.randrange(4)
    if kind == 0:
        return line[:i] + rnd.choice("abé ") + line[i:]
    if kind == 1 and i < len(line):
        return line[:i] + line[i + 1 :]
    if kind == 2 and i < len(line):
        return line[:i] + rnd.choice("xyzß") + line[i + 1 :]
    return line


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([10, 11, 12, 40, 41, 90, 700]))) for _ in range(12)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(variant(rnd, variant(rnd, rnd.choice(pool))) for _ in range(rnd.randrange(1, 6)))))
    want = brute_all_earlier(rows, 10)
    for most in (0, 400_000):  # joins that shuffle, and that broadcast
        out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=10, broadcast_rows=most)
        got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
        assert [got[i][0] for i in range(60)] == want
        assert sum(got[i][1] for i in range(60)) > 40


def test_lines_of_odd_rows(spark, odd, empty, odd_rows):
    clashing = odd.withColumnRenamed("source", "n_dropped").withColumnRenamed("lang", "row_key")
    out = line_dedup.dedup(clashing)
    assert out.columns == [*clashing.columns, "_n_dropped"]
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    texts = Counter(r["text"] for r in rows)
    assert texts[None] == 2 and texts["word"] == 1
    assert texts["12 34 !!"] == 2  # too short to count
    assert sum(r["text"] == odd_rows[0][1] for r in rows) == 1
    assert line_dedup.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup(odd, min_chars=1)


def test_short_lines_that_repeat_go(spark, tmp_path):
    import corpus_pipeline

    texts = ["All rights reserved.\n\nOk.\n \nThe first one here.", "Ok.\n\nAll rights reserved.\nNo.\n ", "The first, one here.\nOn.\nAll rights reserved.\nNo."]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(texts[0], 0), ("\nNo.\n ", 2), ("On.", 3)]
    assert [tuple(r)[1:] for r in sorted(line_dedup.op2_line_dedup(spark, str(tmp_path)).collect())] == want
    staged = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in staged) == [(i, t, len(t)) for i, (t, _) in enumerate(want)]


def brute_exact(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(text or "", []).append((doc_id is not None, doc_id or 0, i))
    return {t: (len(g), max(g)) for t, g in groups.items()}


@pytest.mark.parametrize("size", [1, 4, 4096])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(spark, odd_rows, size, collide):
    rnd = random.Random(size)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 7)))) for i in range(60)] + [(100 + i, t) for i, (_, t, *_) in enumerate(odd_rows) if size > 1 and (size > 4 or len(t or "") < 200)]
    df = spark.createDataFrame(rows, "key long, text string")
    hashes = (lambda b: [F.lit(0).alias("h1"), F.lit(0).alias("h2")]) if collide else exact_dedup._hash
    out = exact_dedup.identities(df, "key", block_bytes=size, hashes=hashes).collect()
    names = {r["key"]: (r["level"], r["name"]) for r in out}
    texts = {k: t or "" for k, t in rows}
    assert names.keys() == texts.keys()
    for a in texts:
        for b in texts:
            assert (names[a] == names[b]) == (texts[a] == texts[b])


def test_exact_of_odd_rows(spark, odd, empty, odd_rows):
    got = exact_dedup.groups(odd).collect()
    want = brute_exact([(r[0], r[1]) for r in odd_rows])
    assert len(got) == len(odd_rows)
    assert Counter(r["group_size"] for r in got) == Counter(want[t or ""][0] for _, t, *_ in odd_rows)
    assert sum(r["kept"] for r in got) == len(want)
    for r in got:
        if r["id"] == 1:
            assert (r["keep_id"], r["kept"]) == (3, False)
        if r["id"] == 5:
            assert r["keep_id"] == 5 and r["group_size"] == 3
    assert exact_dedup.groups(empty).count() == 0


def test_op7(spark, sf_dir, odd_rows, empty_dir):
    rows = exact_dedup.op7_exact_dedup(spark, sf_dir).collect()
    assert Counter(r["text_sha256"] for r in rows) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_rows)
    assert exact_dedup.op7_exact_dedup(spark, empty_dir).count() == 0


# --- near duplicates


def sets_of(texts):
    out = []
    for t in texts:
        w = words(t or "")
        n = min(5, len(w))
        out.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    return out


def brute_similarity(a, b):
    if not a and not b:
        return 1.0
    union = a.keys() | b.keys()
    plain = len(a.keys() & b.keys()) / len(union)
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in union)
    return max(plain, total)


def test_plain_similarity_makes_candidates(spark):
    base = " ".join(f"w{i}x" for i in range(300))
    rows = [(1, base), (2, base + " one two three four five" * 300), (3, base + " six seven eight nine ten" * 90), (4, "something else " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["class_id"] for r in near_dedup.classify(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def brute_classes(texts, threshold=0.8):
    s, parent = sets_of(texts), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if brute_similarity(s[i], s[j]) >= threshold:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(s))]


def test_similarity_is_exact():
    rnd = random.Random(5)
    for _ in range(40):
        a, b = (" ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60))) for _ in range(2))
        x, y = (near_dedup.shingles(words(t)) for t in (a, b))
        assert math.isclose(near_dedup.similarity(x, y), brute_similarity(*sets_of([a, b])), abs_tol=1e-9)


def test_registers_estimate_probability_jaccard():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**63, 60).astype(np.uint64)
    x, y = (np.sort(h[:45]), rnd.integers(1, 6, 45)), (np.sort(h[15:]), rnd.integers(1, 6, 45))
    one, two = near_dedup.sketch([x, y], 20_000)
    wx, wy = dict(zip(x[0].tolist(), x[1].tolist(), strict=True)), dict(zip(y[0].tolist(), y[1].tolist(), strict=True))
    want = sum(1 / sum(max(wx.get(j, 0) / wx[i], wy.get(j, 0) / wy[i]) for j in wx.keys() | wy.keys()) for i in wx.keys() & wy.keys())
    assert abs((one == two).mean() - want) < 0.015


@pytest.mark.parametrize("seed", range(2))
def test_near_classes_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 120, 200]))]
        for _ in range(rnd.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["", None, "!!", "one two", "One, two", "one two three"]
    rnd.shuffle(texts)
    out = near_dedup.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["id"]: r["class_id"] for r in out}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["id"] == r["class_id"]) for r in out)


def test_recall_by_similarity_band(spark):
    """Of linked pairs nearly all fall into one class, also where blocks repeat, and in a large group of unlike near copies."""
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(20):  # pairs of growing distance
        base = [rnd.choice(vocabulary) for _ in range(120)]
        for k in (0, 1, 2, 4):
            own = list(base)
            for _ in range(k):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    for times in (5, 10, 20):  # the same passage, repeated in one copy
        for _ in range(10):
            base = [rnd.choice(vocabulary) for _ in range(150)]
            texts += [" ".join(base), " ".join(base + base[:20] * times)]
    base = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(50):  # many of them under the threshold to each other
        own = list(base)
        for _ in range(rnd.randrange(7)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        texts.append(" ".join(own) + " tail tail tail tail tail tail" * rnd.choice([0, 0, 1, 30]))
    out = near_dedup.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=32).collect()
    got = {r["id"]: r["class_id"] for r in out}
    sets, bands, links = sets_of(texts), {}, []
    for i in range(len(texts)):
        for j in range(i):
            if sets[i].keys() & sets[j].keys() and (s := brute_similarity(sets[i], sets[j])) >= 0.8:
                links.append((j, i))
                band = bands.setdefault(min(int(s * 20), 19), [0, 0])
                band[0] += got[i] == got[j]
                band[1] += 1
    assert len(bands) >= 3 and all(found >= 0.99 * n for found, n in bands.values()), bands
    least = list(range(len(texts)))
    for _ in texts:  # until labels stand still
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert all(got[i] == got[least[i]] or sum(i in x for x in links) for i in got) and all(least[i] == least[c] for i, c in got.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=90), st.lists(st.integers(0, 4), min_size=1, max_size=90))
def test_bitmaps_bound_what_sets_differ_in(a, b):
    def own(xs, wide):
        h = np.unique(near_dedup.mix(np.array(xs, np.uint64) * np.uint64(7) + np.arange(len(xs), dtype=np.uint64) // np.uint64(3)))
        return np.unique(np.concatenate([h, near_dedup.mix(np.arange(wide, dtype=np.uint64))]))

    x, y = own(a, 10), own(b, 900)
    p, q = (near_dedup.parities(h).view(np.uint64) for h in (x, y))
    n = min(len(p), len(q))
    fold = lambda w: np.bitwise_xor.reduce(w.reshape(-1, n), axis=0)
    assert sum(int(v).bit_count() for v in fold(p) ^ fold(q)) <= len(np.setxor1d(x, y))


def test_differing_bits(spark):
    rows = [([1, 2], [3, 0]), ([-1], [0]), ([5, 6, 7, 8], [1, 1]), ([4], [1, 1, 1, 1, 1, 1, 1, 3])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    fold = lambda w, n: [int(np.bitwise_xor.reduce(np.array(w[i::n], np.int64))) for i in range(n)]
    want = [sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(fold(a, n), fold(b, n), strict=True)) for a, b in rows for n in [min(len(a), len(b))]]
    assert [r[0] for r in df.select(near_dedup._differing(F.col("a"), F.col("b"))).collect()] == want


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e}


def test_near_of_odd_rows(spark, odd, empty, odd_rows):
    out = near_dedup.classify(odd.withColumnRenamed("lang", "class_id")).collect()
    assert len(out) == len(odd_rows) and sum(r["kept"] for r in out) == len({r["class_id"] for r in out})
    own = {r["id"]: r["class_id"] for r in out if r["id"] is not None}
    assert own[1] == own[2] == own[3] and own[4] == own[5] != own[7]
    assert near_dedup.classify(empty).count() == 0


# --- shards


def brute_shard(key, weights):
    text = "null" if key is None else f"k{key}"
    best = []
    for j, w in enumerate(weights):
        digest = hashlib.md5(f"{text}:{j // 4}".encode()).hexdigest()
        u = (int(digest[8 * (j % 4) : 8 * (j % 4) + 8], 16) + 0.5) / 2**32
        best.append((-math.log(u) / w, j))
    return min(best)[1]


def test_op5(spark, sf_dir, odd_rows, empty_dir):
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), brute_shard(i, [1.0] * 40), brute_shard(i, [1.0] * 41)) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    assert all(r["grown_shard"] in (r["shard"], 40) and r["law"] == "key" for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.op5_sharding(spark, empty_dir).count() == 0


def test_weighted_shares_and_few_moves(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    out = sharding.assign(df, F.col("doc_id"), [1.0, 2.0, 5.0], grown_col="grown", grown_weight=2.0).collect()
    share = Counter(r["shard"] for r in out)
    assert [round(share[i] / 20_000, 1) for i in range(3)] == [0.1, 0.2, 0.6]
    moved = [r for r in out if r["grown"] != r["shard"]]
    assert all(r["grown"] == 3 for r in moved) and 0.18 < len(moved) / 20_000 < 0.22
    with pytest.raises(ValueError):
        sharding.assign(df, F.col("doc_id"), [1.0, 0.0])


def test_shards_of_extreme_ids_and_clashing_names(spark, tmp_path):
    rows = [(2**63 - 1, "ab", 7, 8, 9), (-(2**63), None, 7, 8, 9), (0, "ab", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot long, words int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op5_sharding(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["shard"] for r in out} == {r[0]: brute_shard(r[0], [1.0] * 40) for r in rows}
    placed = sharding.assign(docs, F.col("doc_id"), [1.0, 1.0], grown_col="slot")
    assert placed.columns == [*docs.columns, "_shard", "_slot"] and {r["shard"] for r in placed.collect()} == {7}
    numbered = sharding.number(placed, "_shard", [F.col("doc_id")], F.col("words"))
    assert sorted(numbered.columns) == sorted([*docs.columns, "_shard", "_slot", "__slot"]) and numbered.count() == 3


def test_only_sets_that_pairs_name_are_shuffled(spark):
    """Verifying few pairs doesn't send all texts' shingles around."""
    sets = near_dedup.materialise(near_dedup._shingled(spark.createDataFrame([(i, f"a b c d e f g {i % 50}") for i in range(100)], "key long, text string")), "sets")
    pairs = near_dedup.materialise(spark.createDataFrame([(0, 50), (0, 1)], "a long, b long"), "pairs")
    found = near_dedup._verified(pairs, sets, 0.8)
    assert [tuple(r) for r in found.collect()] == [(0, 50)]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_sets_are_bounded_where_they_lie(spark, monkeypatch):
    """Keys of live texts go to the sets of shingles, whatever Spark would broadcast by itself; what counts shingles doesn't carry them."""
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 100)
    texts = [(1, "a b c d e f"), (2, "a b c d e x x x x x x x"), (3, "a b c d e f g")]
    sets = near_dedup.materialise(near_dedup._shingled(spark.createDataFrame(texts, "key long, text string")), "sets")
    live = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "bucket long, key long")
    keys = near_dedup.materialise(live.select("key").distinct(), "keys")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_dedup._bounded(live, sets, keys)
        rows = sorted((r["bucket"], r["key"], r["size"], r["weight"], r["alone"], r["lone"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Text 3 isn't live, so its shingle counts for none.
    assert rows == [(7, 1, 2, 2, 1, 1), (7, 2, 6, 8, 5, 7), (8, 1, 2, 2, 1, 1)]
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)
