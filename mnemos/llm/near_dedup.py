"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A text is a weighted set of five-word shingles, weights being their counts. Every shingle sends arrivals of a Poisson
process whose rate is its weight, each to a random one of `registers` registers; a register keeps the shingle that comes
first, and a shingle is done once its next arrival is later than every register's. Arrivals depend on the shingle alone, so
two texts agree in a register with the probability Jaccard similarity of their weighted sets. A text with a repeated shingle
is sketched once more with weights of 1, where texts agree with their plain Jaccard similarity (of other texts both sketches
are the same). Bands of registers make bucket keys; texts that share a bucket are candidates, and pairs are verified on their
exact shingles: they are linked if the probability Jaccard or the plain Jaccard similarity reaches the threshold. Classes are
the connected components.

No bucket emits all its pairs. Texts of equal words are one from the start; buckets with the same members are one. In each
round a bucket's leaders are compared with its members of other classes, then leave it: at first the member that shares
most buckets, later members of the bucket's smallest class, more of them in each round. A pair within one class needs
no test, so a bucket is done when it has one class left. After the first round the shingles that
no other text has, and bitmaps of their parities, bound the similarity of what is left: members that can't reach the
threshold leave, pairs that can't aren't made. The rounds end when no bucket is left, and no link between classes is lost (but by banding: a pair at 0.8
by either similarity misses all 32 bands of 6 with probability 6e-5).

Words are those of common.words(). A text of fewer than five words is one shingle of them all. Null texts and texts without
words form one class. Repeated rows fall into one class; the class id is the smallest row key: the id where ids are distinct
integers, else a row number. An empty table stays empty. Very long texts are shingled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.common import bound_batches, discard, keyed, materialise, resident, sided, slices, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
BROADCAST_ROWS = 400_000
#: A round takes so many times the leaders of the one before.
GROWTH = 8
CACHE_ENTRIES = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- sketches ---------------------------------------------------------------------------------------------------


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value




def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(own: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a list of words, and their counts."""
    known = resident("word hashes", 0, _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    if not len(own):
        return hashes, np.zeros(0, np.int64)
    size = min(size, len(own))
    with np.errstate(over="ignore"):
        total = np.full(len(own) - size + 1, size, np.uint64)
        for k in range(size):
            total = mix(total ^ hashes[k : k + len(total)])
    return np.unique(total, return_counts=True)


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """For each non-empty weighted set the shingle that each register keeps (sets x registers)."""
    sizes = np.array([len(h) for h, _ in sets])
    h = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(np.float64)
    row = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * registers, np.inf)
    kept = np.zeros(len(sets) * registers, np.uint64)
    at = np.zeros(len(h))
    turn = 0
    with np.errstate(over="ignore"):
        while len(h):
            draw = mix(h ^ mix(np.array([2 * turn + 1], np.uint64)))
            at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            slot = row * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, slot, at)
            won = at == first[slot]
            kept[slot[won]] = h[won]
            alive = at < first.reshape(-1, registers).max(axis=1)[row]
            h, rate, row, at = h[alive], rate[alive], row[alive], at[alive]
            turn += 1
    return kept.reshape(-1, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the exact probability Jaccard and the plain Jaccard similarity of two weighted sets."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(both)
    if not union:
        return 1.0
    plain = len(both) / union
    if plain == 0 or (a[1].max() == 1 and b[1].max() == 1):
        return plain
    x = np.concatenate([a[1][ia], np.delete(a[1], ia), np.zeros(len(b[0]) - len(ib))]).astype(np.float64)
    y = np.concatenate([b[1][ib], np.zeros(len(a[0]) - len(ia)), np.delete(b[1], ib)]).astype(np.float64)
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ordered = ratio[order]
    fore = np.concatenate([[0], np.cumsum(y[order])])
    aft = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]])
    n = len(both)
    cut = np.searchsorted(ordered, ratio[:n], side="left")
    return max(plain, float((1 / (aft[cut] / x[:n] + fore[cut] / y[:n])).sum()))


def _sketches(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """key, words (a 128-bit hash of the word sequence) and band keys of each text (none without words), of both sketches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 32))
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                split = [words(x) for x in texts]
                own = [xxhash.xxh3_128_digest(b" ".join(w)) for w in split]
                full = [i for i, w in enumerate(split) if w]
                lists: list = [[]] * len(split)
                if full:
                    sets = [shingles(split[i]) for i in full]
                    again = [k for k, (_, counts) in enumerate(sets) if counts.max() > 1]
                    sets += [(sets[k][0], np.ones_like(sets[k][1])) for k in again]
                    kept = sketch(sets, bands * per_band).reshape(len(sets), bands, per_band)
                    with np.errstate(over="ignore"):
                        total = np.tile(numbers, (len(sets), 1))
                        for r in range(per_band):
                            total = mix(total ^ kept[:, :, r])
                    for i, band in zip([*full, *[full[k] for k in again]], total.view(np.int64).tolist(), strict=True):
                        lists[i] = list({*lists[i], *band})
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array(own, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["key", "words", "bands"])

    return rows.mapInArrow(made, "key long, words binary, bands array<long>")


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of the hashes that fall on each bit: a bit or more a hash, up to 1024 in all.

    Two sets whose bitmaps differ in n bits differ in n elements at least. The larger of two bitmaps, folded, is comparable
    with the smaller one.
    """
    words = min(16, 1 << (len(hashes) // 64).bit_length())
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _shingled(rows: DataFrame) -> DataFrame:
    """key, hashes (sorted as unsigned), counts and the bitmap of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                sets = [shingles(words(x)) for x in texts]
                columns = [[h.view(np.int64) for h, _ in sets], [c.astype(np.int32) for _, c in sets], [parities(h) for h, _ in sets]]
                lists = [pa.array(x, pa.list_(kind)) for x, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], *lists], ["key", "hashes", "counts", "bits"])

    return rows.mapInArrow(made, "key long, hashes array<long>, counts array<int>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. Only sets that a pair names are shuffled."""

    @F.arrow_udf("double")
    def similar(ha: pa.Array, ca: pa.Array, hb: pa.Array, cb: pa.Array) -> pa.Array:
        view = lambda h, c: (h.values.to_numpy().view(np.uint64), c.values.to_numpy())
        return pa.array([similarity(view(ha[i], ca[i]), view(hb[i], cb[i])) for i in range(len(ha))], pa.float64())

    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    named = right.join(_sided(pairs.select("b").distinct()), "b", "left_semi")
    joined = left.join(_sided(pairs), "a").join(named, "b")
    return joined.withColumn("s", similar("ha", "ca", "hb", "cb")).where(F.col("s") >= threshold).select("a", "b")


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of the edges (a, b); the label is the component's smallest node.

    Each round takes the least label among the neighbours and then that label's own label; the tables are written, so
    the plan doesn't grow. Hubs are aggregated before they are joined.
    """
    both = _kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _kept(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = _kept(least.join(jump, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, key) of buckets with two members or more; of buckets with the same members one is left."""
    all_rows = reps.select("key", F.explode("bands").alias("bucket"))
    # A key is in a bucket once.
    shared = materialise(all_rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    several = materialise(all_rows.join(_sided(shared), "bucket"), "several")
    sizes = several.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    once = materialise(sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")), "buckets")
    members = materialise(several.join(_sided(once), "bucket").select("bucket", "key", (F.col("n") * F.col("times")).alias("weight")), "members")
    discard(shared, several, once)
    return members


def _sided(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows and their bytes stay within the bounds."""
    return sided(table, BROADCAST_ROWS)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A table of a round, written by few tasks: rounds get small soon."""
    return materialise(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), label)


#: What bounds the similarity of a text to others: shingles and their weight, the shingles that no other live text has and
#: their weight, and the bitmap.
BOUNDS = {"size": "int", "weight": "long", "alone": "long", "lone": "long", "bits": "array<long>"}


def _plain(sizes: Column, common: Column) -> Column:
    """The plain Jaccard similarity of sets with so many elements in both."""
    return common / (sizes - common)


def _differing(a: Column, b: Column) -> Column:
    """The bits in which two bitmaps differ; parts of the larger one are laid over each other."""
    words = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) == words, x).otherwise(
        F.transform(F.slice(x, F.lit(1), words), lambda first, i: F.aggregate(F.sequence(i + words, F.size(x) - 1, words), first, lambda z, j: z.bitwiseXOR(F.get(x, j))))
    )
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, c: n + c)


def _bounded(live: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """live, whose distinct keys are keys (written), with BOUNDS. A shingle that no other live text has is in no intersection.

    Sets stay where they are if the keys can be broadcast; what is told without shingles is computed before it is joined.
    """
    known = _sided(keys)
    own = sets.select("key", "hashes", "counts").join(known, "key", "left_semi")
    pairs = own.select("key", F.explode(F.arrays_zip("hashes", "counts")).alias("x"))
    lone = pairs.groupBy("x.hashes").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.sum("x.counts").alias("c")).where("key = other")
    lone = lone.groupBy("key").agg(F.count("*").alias("alone"), F.sum("c").alias("lone"))
    sizes = sets.select("key", F.size("hashes").alias("size"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("weight"), "bits").join(known, "key", "left_semi")
    return live.join(sizes.join(lone, "key", "left").na.fill(0).select("key", *BOUNDS), "key")


def _hopeful(live: DataFrame, threshold: float) -> DataFrame:
    """Bounded live members without those that can't be linked to any other of their bucket.

    With m between the bucket's least and greatest sizes, the best partner of a text that has at most k shingles in common
    with others is one with k shingles, or the nearest size. Its probability Jaccard similarity is at most the share of weight
    of what others may have.
    """
    bounds = live.groupBy("bucket").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("weight") - F.col("size")).alias("extra"))
    k = F.col("size") - F.col("alone")
    m = F.least(F.greatest(k, F.col("least")), F.col("most"))
    best = _plain(F.col("size") + m, F.least(k, m))
    best = F.when(F.col("extra") == 0, best).otherwise(F.greatest(best, 1 - F.col("lone") / F.col("weight")))
    return live.join(bounds, "bucket").where(best >= threshold - 1e-9).select(*live.columns)


def _possible(threshold: float) -> Column:
    """Whether a leader (l_...) and a member may be linked, as far as their bounds tell; the bitmaps are looked at last.

    With p and q the least weights that one text has without the other, and P and Q what is left of their weights, the
    probability Jaccard similarity is 1 / (1 + p/P + q/Q) at most: a common shingle adds at most 1 / (p/x + q/y +
    max(P/x, Q/y)), x and y being its counts, which is concave and homogeneous in x and y, so the sum is largest if the
    counts of common shingles are in proportion.
    """
    sizes = F.col("size") + F.col("l_size")
    common = F.least(F.col("size") - F.col("alone"), F.col("l_size") - F.col("l_alone"))

    def enough(most: Column, own: Column, other: Column) -> Column:
        left, l_left = F.col("weight") - own, F.col("l_weight") - other
        weighted = F.when((left > 0) & (l_left > 0), 1 / (1 + own / left + other / l_left)).otherwise(0.0)
        return F.greatest(_plain(sizes, most), weighted) >= threshold - 1e-9

    differing = _differing(F.col("bits"), F.col("l_bits"))
    least = lambda lone, more: F.greatest(F.col(lone), F.ceil((differing + more) / 2))
    more = F.col("size") - F.col("l_size")
    finer = enough(F.least(common, F.floor((sizes - differing) / 2)), least("lone", more), least("l_lone", -more))
    return F.when(F.col("size").isNull(), True).when(enough(common, F.col("lone"), F.col("l_lone")), finer).otherwise(False)


def _several(counts: DataFrame) -> DataFrame:
    """Buckets with two classes or more."""
    return counts.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")


def _left(own: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members but the leaders (bucket, key, label), of buckets that have two classes without them, and n, how many of the
    bucket are in a member's class."""
    one = lambda rows, n: rows.select("bucket", "label", F.lit(n).alias("n"))
    counts = one(own, 1).unionByName(one(leaders, -1)).groupBy("bucket", "label").agg(F.sum("n").alias("n")).where("n > 0")
    live = own.join(counts.join(_several(counts), "bucket", "left_semi"), ["bucket", "label"])
    return live.join(leaders.select("bucket", "key"), ["bucket", "key"], "left_anti")


def _relabelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with their keys' labels of now."""
    if labels is None:
        return rows
    return rows.withColumnRenamed("label", "own").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "own")).drop("own")


def _classes(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """(node, label) of all keys that are linked with others."""
    central = members.groupBy("key").agg(F.sum("weight").alias("central"))
    unknown = [F.lit(None).cast(kind).alias(c) for c, kind in BOUNDS.items()]
    live = materialise(members.drop("weight").join(central, "key").select("bucket", "key", "central", F.col("key").alias("label"), F.lit(1).cast("long").alias("n")), "live")
    labels, tested, leaders_now = None, None, 1
    while not live.isEmpty():
        order = Window.partitionBy("bucket").orderBy("n", F.desc("central"), "key")
        wide = live.select("*", *unknown) if leaders_now == 1 else live
        leaders = _kept(wide.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders_now).drop("place", "n", "central"), "leaders")
        renamed = leaders.select(F.col("bucket").alias("l_bucket"), F.col("key").alias("leader"), F.col("label").alias("own"), *[F.col(c).alias(f"l_{c}") for c in BOUNDS])
        met = wide.join(renamed, (F.col("bucket") == F.col("l_bucket")) & (F.col("own") != F.col("label")) & _possible(threshold))
        pairs = met.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _kept(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _kept(_verified(pairs, sets, threshold), "links")
        own, done = live.drop("n"), [live, leaders]
        if links.isEmpty():
            discard(links)
        else:
            done.append(links)
            if labels is not None:
                of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
                links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
            merged = components(links)
            if labels is None:
                labels = merged
            else:
                old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                labels = _kept(old.unionByName(merged.join(labels, "node", "left_anti")), "labels")
            own, leaders = _kept(_relabelled(own, labels), "own"), _relabelled(leaders, labels)
            done.append(own)
        if leaders_now == 1:
            unsure = _kept(own.join(_several(own), "bucket", "left_semi"), "unsure")
            keys = _kept(unsure.select("key").distinct(), "keys")
            bounded = _kept(_bounded(unsure, sets, keys), "bounded")
            own = _kept(_hopeful(bounded, threshold), "hopeful")
            discard(unsure, keys, bounded)
            leaders = leaders.join(own.select("bucket", "key"), ["bucket", "key"], "left_semi")
            done.append(own)
        live = _kept(_left(own, leaders), "live")
        discard(*done)
        leaders_now *= GROWTH
    return labels


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """row_key, id, class_id, class_size and kept (the row with the smallest key of its class) for every row of docs."""
    rows = keyed(docs.select(id_col, text_col), id_col, "row_key")
    return keyed_classes(rows, id_col, text_col, threshold, bands, per_band)


def keyed_classes(rows: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """classify() of rows with a unique row_key."""
    bound_batches(rows.sparkSession)
    narrow = rows.select(F.col("row_key").alias("key"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(_sketches(narrow, bands, per_band), "sketches")
    copies = materialise(sketches.groupBy("words").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "copies")
    repeated = materialise(copies.where("n > 1").select("words", "rep"), "repeated")
    others = materialise(sketches.select("key", "words").join(_sided(repeated), "words").where("key <> rep").select("key"), "others")
    members = _buckets(sketches.select("key", "bands").join(_sided(others), "key", "left_anti"))
    discard(repeated, others)
    wanted = materialise(members.select("key").distinct(), "wanted")
    sets = materialise(_shingled(narrow.join(_sided(wanted), "key", "left_semi")), "shingles")
    labels = _classes(members, sets, threshold)
    if labels is None:
        found = copies.select("words", F.col("rep").alias("class_id"), "n")
    else:
        found = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("words", F.coalesce("label", "rep").alias("class_id"), "n")
    found = materialise(found, "classes")
    discard(sets, members, wanted, copies)
    sizes = found.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    classes = sketches.select(F.col("key").alias("row_key"), "words").join(found.join(sizes, "class_id").select("words", "class_id", "class_size"), "words")
    ids = rows.select("row_key", F.col(id_col).alias("id"))
    return ids.join(classes, "row_key").select("row_key", "id", "class_id", "class_size", (F.col("row_key") == F.col("class_id")).alias("kept"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
