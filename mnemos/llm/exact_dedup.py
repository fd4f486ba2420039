"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get one integer name: the distinct blocks are dealt by
range, sorted and numbered, so names are unique and follow one order over all parts. Then neighbouring names are paired and distinct pairs are sorted and numbered, level by level, until every
document is down to one name; a name without a neighbour pairs with none. Two texts are equal just if they end on the same
level with the same name, whatever their contents: names are places in sorted lists, not fingerprints.

Distinct blocks are found by one shuffle of the blocks after a map-side combine, so thousands of copies of a block travel
once a task. Occurrences learn their names by a 128-bit hash of the block; the shuffle of the contents tells whether
two blocks share a hash, and if any two do, occurrences are joined by content instead. Each level moves half as many rows
as the one before. Joins are equi-joins whose hot keys adaptive execution can split.

Null counts as the empty text, which has one empty block. Repeated rows are rows of their own, equal to each other. Of
equal texts the row with the largest id stays (null ids lose; of rows with the same id one). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import keyed, materialise

BLOCK_BYTES = 4096
#: Bytes of a block that bounds of ranges have.
BOUND_BYTES = 64


def _hash(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(1), block).alias("h2")]


def _blocks(content: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest((F.octet_length(content) - 1).cast("int"), F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(content, i + 1, F.lit(size)))


def _numbered(distinct: DataFrame, by: list[str], kept: list[str]) -> DataFrame:
    """Rows with a number each, in their order over all partitions; written, so every reader sees the same numbers.

    Blocks are ordered by their first bytes, a hash and then their bytes: ranges need no whole blocks as bounds, and many
    blocks that begin alike are still dealt out.
    """
    order = [x for c in by for x in ((F.substring(c, 1, BOUND_BYTES), F.xxhash64(c)) if c == "block" else (F.col(c),))]
    named = distinct.repartitionByRange(*order).sortWithinPartitions(*order, *by).select(*kept, F.monotonically_increasing_id().alias("name"))
    return materialise(named, "names")


def identities(docs: DataFrame, key: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashes=_hash) -> DataFrame:
    """key, level and name of every document (the two are its identity); key has to be unique."""
    content = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    blocks = docs.select(F.col(key).alias("key"), F.posexplode(_blocks(content, block_bytes)).alias("pos", "block"))
    hashed = blocks.select("key", "pos", *hashes(F.col("block")))
    distinct = docs.select(F.explode(_blocks(content, block_bytes)).alias("block")).select("block", *hashes(F.col("block"))).distinct()
    names = _numbered(distinct, ["block"], ["h1", "h2"])
    if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        level = hashed.join(names, ["h1", "h2"]).select("key", "pos", "name")
    else:
        names = _numbered(distinct.select("block"), ["block"], ["block"])
        level = blocks.join(names, "block").select("key", "pos", "name")
    level = materialise(level, "level")
    done, number = [], 0
    while True:
        paired = level.groupBy("key", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"),
            F.max("pos").alias("last"),
        )
        tops = level.groupBy("key").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        done.append(tops.where("last = 0").select("key", F.lit(number).alias("level"), "name"))
        more = tops.where("last > 0").select("key")
        if more.isEmpty():
            break
        pairs = paired.join(more, "key", "left_semi").select("key", F.col("half").alias("pos"), "a", F.coalesce("b", F.lit(-1)).alias("b"))
        pairs = materialise(pairs, "pairs")
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        level = materialise(pairs.join(named, ["a", "b"]).select("key", "pos", "name"), "level")
        number += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, keep_id (the id of the row that stays), group_size and kept for every row, and row_key, its number.

    Sizes and survivors are aggregated by identity before they are joined back, so no task gathers a group.
    """
    return keyed_groups(keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, "row_key"), id_col, text_col, block_bytes)


def keyed_groups(rows: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """groups() of rows with a unique row_key."""
    names = identities(rows, "row_key", text_col, block_bytes)
    own = materialise(rows.select("row_key", F.col(id_col).alias("id")).join(names.withColumnRenamed("key", "row_key"), "row_key"), "identities")
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("row_key")))
    sizes = own.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    return own.join(sizes, ["level", "name"]).select("row_key", F.col("id"), F.col("best")["id"].alias("keep_id"), "group_size", (F.col("row_key") == F.col("best")["row_key"]).alias("kept"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = keyed(docs, "doc_id", "row_key")
    digests = rows.select("row_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    found = keyed_groups(rows, "doc_id", "text")
    return found.join(digests, "row_key").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
