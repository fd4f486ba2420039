"""Conversation trie, toxicity and source divergence: brute force, collisions, held-out accuracy, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.llm import divergence, prefix_trie, toxicity

CONVS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


# --- conversations


def conversation_rows():
    rnd = random.Random(11)
    rows = []
    for c in [*range(0, 64), -25, 10**12]:
        if c in (20, 41):  # the base of a group is missing; a conversation without rows is none
            continue
        n = rnd.choice([0, 1, 2, 3, 5, 8]) if c % 20 else rnd.choice([1, 2, 6])
        for t in range(n):
            role, text = ("user", "assistant")[t % 2], rnd.choice(["hi there", "a  b\tc d", "", "same words again"])
            rows.append((c, t, role, text))
    rows += [(3, None, "system", None), (3, None, None, "first"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "assistant", "tie"), (None, 1, "user", "nobody's")]
    rows += [(7, t, "user", "copy") for t in range(40)] + [(8, t, "user", "copy") for t in range(41)] + [(9, t, "user", "copy") for t in range(40)]
    rnd.shuffle(rows)
    return rows


def brute_nodes(convs):
    """convs: {id: list of (role, text)}."""
    if not convs:
        return {}
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = {}
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        out[min(own), len(p)] = (min(members[p[:-1]]) if p else None, len(own), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def ordered(rows):
    out = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return dict(out)


def spliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def as_dict(nodes):
    rows = nodes.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_against_brute_force(spark, tmp_path):
    rows = conversation_rows()
    spark.createDataFrame([(*r, 1) for r in rows], CONVS + ", rep long").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = ordered(rows)
    assert as_dict(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) == brute_nodes(spliced(convs))
    assert as_dict(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVS))) == brute_nodes(convs)


def test_turnless_conversations_are_the_roots(spark):
    turns = prefix_trie.turn_table(spark.createDataFrame([(21, 0, "user", "gone")], CONVS))
    found = as_dict(prefix_trie.nodes(*prefix_trie.spliced_paths(turns), turns))
    h = zlib.crc32(b"21") % 4
    assert found == brute_nodes({21: [("user", "gone")][h:]})


@pytest.mark.parametrize("bits", [0, 2])
def test_collisions_split(spark, bits):
    rows = [r for r in conversation_rows() if r[0] is not None and r[0] < 9 and (r[1] or 0) < 6]
    turns = prefix_trie.turn_table(spark.createDataFrame(rows, CONVS))
    assert as_dict(prefix_trie.nodes(*prefix_trie.own_paths(turns), turns, bits=bits)) == brute_nodes(ordered(rows))


def test_scan_over_many_parts(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.randrange(-(2**63), 2**63), i % 3) for k, n in ((1, 3), (2, 4000), (3, 0), (4, 1), (5, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, h long, one long").repartition(7)
    found = prefix_trie.running(df, "k", [F.asc("i")], powers="i", f="h").collect()
    want, held = {}, defaultdict(int)
    for k, i, h, _ in rows:
        held[k] = (held[k] + h * pow(prefix_trie.BASE, i, 2**64)) % 2**62
        want[k, i] = held[k]
    assert {(r["k"], r["i"]): r["f"] for r in found} == want
    back = {(r["k"], r["i"]): (r["a"], r["b"]) for r in prefix_trie.running(df, "k", [F.desc("i")], a="one", b="i").collect()}
    for k, i, _, _ in rows[::97]:
        assert back[k, i] == (sum(r[3] for r in rows if r[0] == k and r[1] >= i), sum(r[1] for r in rows if r[0] == k and r[1] >= i))


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([(None, 1, "a", "b")], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op11_prefix_trie(spark, str(tmp_path)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).count() == 0


# --- toxicity


def toxic_rows(n=400):
    rnd = random.Random(5)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "ren", "sol") for b in ("na", "ker", "vin", "dor", "pel")]
    rows, labels, spans = [], [], {}
    for i in range(n):
        sentences = [" ".join(rnd.choice(plain) for _ in range(rnd.randrange(3, 12))) for _ in range(rnd.randrange(2, 30))]
        bad = i % 5 == 0
        if bad:
            at = rnd.randrange(len(sentences))
            sentences[at] += " " + rnd.choice(["vilescum", "grub", "rottenhead", "rottenfoot"])
            start = sum(len(s) + 1 for s in sentences[:at])
            spans[i] = f"{start}:{start + len(sentences[at])}"
        rows.append((i, ".".join(sentences), "en", "a"))
        labels.append((i, int(bad)))
    return rows, labels, spans


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows, labels, spans = toxic_rows()
    odd = [(1000, None, None, None), (1001, "", "", ""), (None, "rottenhead", None, None), (1002, "GRUB! " + "clean words here. " * 20_000, "en", "a"), (1003, "clean words here. " * 20_000, "en", "a"), (1004, "。grub。", None, None)]
    spark.createDataFrame(rows + odd, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (0, 0), (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) + len(odd)
    own = {r["doc_id"]: r for r in found}
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found if r["held_out"]} == {r[0] for r in rows + odd if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 == 2}
    for i, toxic in labels:
        assert own[i]["predicted"] == toxic
        if toxic:
            assert own[i]["sentences"] == spans[i]
    assert (own[1000]["score"], own[1001]["score"], own[1003]["predicted"]) == (0.0, 0.0, 0)
    assert own[None]["predicted"] == own[1002]["predicted"] == own[1004]["predicted"] == 1
    assert (own[1002]["sentences"], own[1004]["sentences"]) == ("0:4", "1:5")


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", 3)], "doc_id long, text string, score int")
    for labels in ([], [(1, 0)], [(1, None)], [(2, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
        row = model.score(docs).first()
        assert (row["score"], row["_score"], row["sentences"]) == (3, 0.0, [])


def test_gradient_of_noisy_or():
    """The fit ends where the ridge-penalised likelihood is level: moving any weight makes it no better."""
    rnd = random.Random(2)
    bags = [(int(rnd.random() < 0.4), [[f for f in range(4) if rnd.random() < 0.4] for _ in range(rnd.randrange(1, 5))]) for _ in range(60)]
    weights, bias = toxicity.trained(bags, 4, (0.5, 1.0), rounds=3000, rate=0.03)

    def loss(w, b):
        scale = np.mean([2.0 if y == 0 else 1.0 for y, _ in bags])
        total = 0.0
        for y, sentences in bags:
            p = toxicity.noisy_or(1 / (1 + np.exp(-(b + sum(w[f] for f in s)))) for s in sentences)
            total -= (2.0 if y == 0 else 1.0) / scale * np.log(p if y else 1 - p)
        return total + 0.01 * sum(x * x for x in w)

    best = loss(weights, bias)
    for k in range(5):
        for step in (-0.05, 0.05):
            w = weights.copy()
            if k < 4:
                w[k] += step
            assert loss(w, bias + (step if k == 4 else 0)) > best - 1e-4


# --- divergence


def brute_audit(rows, least=3, ranks=200):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    docs = [(lang or "", source or "", split(text)) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2]) for s in {d[1] for d in own}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def audit_rows():
    rnd = random.Random(9)
    words = ["the", "The", "naïve", "x中y", "a1b", "don't", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", " 7 "]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", None, "Ä"])) for i in range(150)]
    return [*rows, (1, None, "en", "empty"), (2, "", "xx", "s"), (3, "only here", "xx", "t"), (None, "rare", None, None), (4, "the " * 5000, "en", "a"), (4, "the " * 5000, "en", "a")]


@pytest.mark.parametrize("cells", [None, 8, 1 << 10])
def test_audit_against_brute_force(spark, cells):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("value", F.lit(1)).repartition(5)
    found = sorted(tuple(r) for r in divergence.audit(docs, ranks=7, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute_audit(rows, ranks=7)


def test_sketch_never_underestimates():
    rnd = random.Random(4)
    sketch, true = divergence.Sketch(64, 3), Counter()
    for _ in range(20):
        counts = Counter({f"t{rnd.randrange(400)}".encode(): rnd.randrange(1, 3) for _ in range(30)})
        sketch.add("en", counts)
        true.update(counts)
    bits = np.packbits(sketch.table >= 3, bitorder="little").tobytes()
    passed = divergence.Frequent(bits, 64).possible("en", list(true))
    assert all(ok for w, ok in zip(true, passed, strict=True) if true[w] >= 3)
    roomy = divergence.Sketch(1 << 16, 3)
    roomy.add("en", true)
    exact = divergence.Frequent(np.packbits(roomy.table >= 3, bitorder="little").tobytes(), 1 << 16).possible("en", list(true))
    assert sum(ok != (true[w] >= 3) for w, ok in zip(true, exact, strict=True)) <= 2


def test_audit_of_nothing_and_large_counts(spark, empty):
    assert divergence.audit(empty).count() == 0
    n = spark.createDataFrame([(9 * 10**17, 10**18, 5)], "n long, total long, terms long")
    assert n.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (9 * 10**17 + 1) // (10**18 + 5)
