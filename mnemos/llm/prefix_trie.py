"""A trie of conversations by their common beginnings, without walking it.

Turns are put in order by a range partition and a sort; numpy scans each partition, and what a conversation has in earlier
partitions is added afterwards (one row a partition and conversation that goes on in the next), so a conversation of any
length is spread over as many tasks as it needs. The same scan gives each prefix its fingerprint, the sum of the turns'
hashes times powers of an odd base, modulo 2^62. Prefixes of the same depth and fingerprint are candidates for one node; each
is compared, turn against turn, with the candidates' smallest conversation. Prefixes of one node end in equal turns, and so
do, by induction, all that stands before them. Where contents differ, the fingerprints have collided: the odd ones out are
split off, for all deeper prefixes as well, and compared anew.

A node is known by its smallest member and its depth. Sums over subtrees need no levels either: a conversation hands what its
own nodes have at or below each depth (a scan from its end) to the node that its prefix of that depth belongs to.

Order is by turn (null first), then role, then text; null roles and texts count as empty. Rows without a conversation are left
out. Repeated rows are turns of their own. Texts are compared as a whole. Without conversations there is no node, not even a
root. Ties can't arise: nodes are told by conversation and depth. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.llm.common import bound_batches, discard, materialise

#: Base of the fingerprints' polynomials, odd; sums are taken modulo 2 to the BITS, so that two of them fit in a long.
BASE, BITS = 0x9E3779B97F4A7C15, 62
#: Ids that are put together before a node's digest is made.
CHUNK_IDS = 16_384
#: The query's splices: so many turns at most, from the first conversation of each so many.
MOST_SPLICED, SPLICE_GROUP = 3, 20


def running(rows: DataFrame, key: str, order: list[Column], powers: str | None = None, tie: tuple[str, ...] = (), **sums: str) -> DataFrame:
    """rows with running totals (name=column, all long and, but for hashes, not negative) within each key in an order.

    powers: a column i; each value then counts times BASE^i. Rows are dealt by range of key and order, so those of one key
    may lie in several tasks; `tie` only sorts within them. The driver sees two rows a task at most: what the keys that
    reach over an edge have before it.
    """
    mask = (1 << BITS) - 1

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind, last, held, edges = None, None, np.zeros(len(sums), np.uint64), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, keys = batch.schema, batch.column(key).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, len(keys)))
            weight = np.power(np.uint64(BASE), batch.column(powers).to_numpy(zero_copy_only=False).astype(np.uint64)) if powers else np.uint64(1)
            columns = []
            for k, c in enumerate(sums.values()):
                with np.errstate(over="ignore"):
                    total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) * weight, dtype=np.uint64)
                    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
                    before[0] -= held[k] if keys[0] == last else np.uint64(0)
                    columns.append(total - np.repeat(before, lengths))
            if not edges or next(iter(edges)) == keys[0]:  # as long as the first key goes on
                edges = {keys[0]: [int(c[lengths[0] - 1]) & mask for c in columns]}
            last, held = keys[-1], np.array([c[-1] for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(np.zeros(len(keys), bool)), *[pa.array((c & np.uint64(mask)).view(np.int64)) for c in columns]], names)
        if kind is not None:
            edges[last] = [int(x) & mask for x in held]
            own = [pa.array(list(edges), pa.int64()) if f.name == key else pa.nulls(len(edges), f.type) for f in kind]
            yield pa.RecordBatch.from_arrays([*own, pa.array([part] * len(edges), pa.int32()), pa.array([True] * len(edges)), *[pa.array(x, pa.int64()) for x in zip(*edges.values(), strict=True)]], names)

    names = [*rows.columns, "in_part", "is_edge", *sums]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order, *tie)
    local = materialise(dealt.mapInArrow(scan, f"{kinds}, in_part int, is_edge boolean, " + ", ".join(f"`{n}` long" for n in sums)), "scan")
    held: dict[int, list[int]] = {}
    before = []
    for r in local.where("is_edge").select(key, "in_part", *sums).orderBy("in_part").collect():
        if r[0] in held:
            before.append((r[0], r[1], *held[r[0]]))
        held = {r[0]: [(a + b) & mask for a, b in zip(held.get(r[0], [0] * len(sums)), r[2:], strict=True)]} | {k: v for k, v in held.items() if k != r[0]}
    out = local.where("NOT is_edge").drop("is_edge")
    if not before:
        return out.drop("in_part")
    earlier = rows.sparkSession.createDataFrame(before, f"`{key}` long, in_part int, " + ", ".join(f"before_{n} long" for n in sums))
    out = out.join(F.broadcast(earlier), [key, "in_part"], "left")
    return out.withColumns({n: (F.col(n) + F.coalesce(F.col(f"before_{n}"), F.lit(0))).bitwiseAND(F.lit(mask)) for n in sums}).select(*rows.columns, *sums)


@F.arrow_udf(T.LongType())
def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array((len(x.as_py().split()) for x in texts), pa.int64())


def turn_table(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, role, text, hash, n_words): the turns of each conversation, numbered from 1 in their order."""
    bound_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    turns = turns.where("conv_id IS NOT NULL").select("*", F.xxhash64("role", "text").alias("hash"), _word_count(F.col("text").cast("binary")).alias("n_words"), F.lit(1).cast("long").alias("one"))
    return running(turns, "conv_id", [F.asc("turn")], tie=("role", "text"), pos="one").select("conv_id", "pos", "role", "text", "hash", "n_words")


def own_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths of the conversations as they are."""
    paths = turns.select("conv_id", F.col("pos").alias("depth"), "hash", "n_words", F.col("conv_id").alias("at_conv"), F.col("pos").alias("at_pos"))
    return paths, materialise(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths")


def spliced_paths(turns: DataFrame, group: int = SPLICE_GROUP, most: int = MOST_SPLICED) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths of conversations that begin as the first one of their group of ids.

    h, the CRC-32 of the id modulo most + 1, is the number of turns that are taken from there and left out here.
    """
    n = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    convs = n.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h)
    convs = convs.join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialise(convs.select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "convs")
    heads = turns.where((F.col("pos") <= most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "hash", "n_words")
    begin = convs.join(heads, "base").where("depth <= h").select("conv_id", "depth", "hash", "n_words", F.col("base").alias("at_conv"), F.col("depth").alias("at_pos"))
    rest = turns.select("conv_id", "pos", "hash", "n_words").join(convs, "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "hash", "n_words", F.col("conv_id").alias("at_conv"), F.col("pos").alias("at_pos"))
    return begin.unionAll(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _classes(prefixes: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_words, rep, n): the smallest conversation with the same prefix, and how many have it.

    Each round compares contents once; a further one follows only if fingerprints have collided.
    """
    content = turns.select("conv_id", "pos", "role", "text")
    splits = None
    while True:
        keyed = prefixes.withColumn("splits", F.array().cast("array<struct<depth: bigint, times: bigint>>"))
        if splits is not None:
            per = materialise(splits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "times"))).alias("all")), "splits")
            keyed = prefixes.join(per, "conv_id", "left").withColumn("splits", F.filter(F.coalesce("all", F.array()), lambda x: x["depth"] <= F.col("depth"))).drop("all")
        key = ["depth", "fingerprint", "splits"]
        groups = materialise(keyed.groupBy(*key).agg(F.min(F.struct("conv_id", "at_conv", "at_pos")).alias("rep"), F.count("*").alias("n")), "candidates")
        members = materialise(keyed.join(groups, key).select("conv_id", "depth", "n_words", "at_conv", "at_pos", F.col("rep.conv_id").alias("rep"), F.col("rep.at_conv").alias("rep_conv"), F.col("rep.at_pos").alias("rep_pos"), "n"), "members")
        pairs = members.where("n > 1 AND NOT (at_conv = rep_conv AND at_pos = rep_pos)").select("at_conv", "at_pos", "rep_conv", "rep_pos").distinct()
        one = content.select(F.col("conv_id").alias("at_conv"), F.col("pos").alias("at_pos"), "role", "text")
        other = content.select(F.col("conv_id").alias("rep_conv"), F.col("pos").alias("rep_pos"), F.col("role").alias("rep_role"), F.col("text").alias("rep_text"))
        unlike = materialise(pairs.join(one, ["at_conv", "at_pos"]).join(other, ["rep_conv", "rep_pos"]).where("role <> rep_role OR text <> rep_text").select("at_conv", "at_pos", "rep_conv", "rep_pos"), "unlike")
        discard(groups)
        if unlike.isEmpty():
            return members.select("conv_id", "depth", "n_words", "rep", "n")
        more = members.join(unlike, unlike.columns, "left_semi").select("conv_id", "depth", F.lit(1).cast("long").alias("times"))
        splits = materialise((more if splits is None else splits.unionAll(more)).groupBy("conv_id", "depth").agg(F.sum("times").alias("times")), "splits")
        discard(members, unlike)


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes with conversations (`member`) that end there.

    Ids are sorted and joined where they lie; a task that makes a node's digest reads it piece by piece.
    """

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(conv):
                continue
            new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])])
            new[::CHUNK_IDS] = True
            at = np.flatnonzero(new)
            ids = member.tolist()
            chunks = [",".join(map(str, ids[a:b])).encode() for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(conv[at]), pa.array(depth[at]), pa.array(member[at]), pa.array(chunks, pa.binary())], ["conv_id", "depth", "first", "ids"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (conv, depth) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                    state.update(ids.as_py())
                else:
                    state.update(b"," + ids.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names)

    names = ["conv_id", "depth", "ends_sha256"]
    parts = ends.select("conv_id", "depth", "member").repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(join, "conv_id long, depth long, first long, ids binary")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def nodes(paths: DataFrame, lengths: DataFrame, turns: DataFrame, bits: int = BITS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths: (conv_id, depth, hash, n_words, at_conv, at_pos), depths from 1 without gaps, contents at (at_conv, at_pos) of
    turns. lengths: (conv_id, length) of all conversations, those without turns too. bits: of the fingerprints that are used.
    """
    bound_batches(paths.sparkSession)
    first, count = lengths.agg(F.min("conv_id"), F.count("*")).first()
    prefixes = running(paths, "conv_id", [F.asc("depth")], powers="depth", fingerprint="hash")
    prefixes = prefixes.select("conv_id", "depth", "n_words", "at_conv", "at_pos", F.col("fingerprint").bitwiseAND(F.lit((1 << bits) - 1)).alias("fingerprint"))
    members = _classes(prefixes, turns)
    node, zero = ["conv_id", "depth"], F.lit(0).cast("long")
    known = members.where("rep = conv_id")
    above = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"))
    tree = known.join(above, node, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(first)))
    tree = materialise(tree.select(*node, "parent_conv_id", F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("n_words")).alias("saved")), "tree")
    children = tree.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = materialise(tree.join(children, node, "left").na.fill(0, ["n_children"]), "nodes")
    values = tree.select(*node, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), "saved")
    parts = members.select(*node, "rep").join(values, node, "left").na.fill(0, ["leaf", "saved"])
    below = running(parts, "conv_id", [F.desc("depth")], n_leaves="leaf", saved_tokens="saved")
    below = below.groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = lengths.select("conv_id", F.col("length").alias("depth")).join(members.select(*node, "rep"), node, "left")
    ends = ends.select(F.coalesce("rep", F.lit(first)).alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    top = tree.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    root = top.where(F.lit(count > 0)).select(F.lit(first).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    rest = tree.join(below, node).select(*node, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    out = rest.unionAll(root).join(_digests(ends), node, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are, one row a node."""
    turns = turn_table(conversations, conv_col, turn_col, role_col, text_col)
    return nodes(*own_paths(turns), turns)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each beginning with turns of the first one of its twenty."""
    turns = turn_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes(*spliced_paths(turns), turns)
