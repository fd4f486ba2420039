"""Cold archive: dumps of active memories, entities and live relations, and their catalogue."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.schemas import ARCHIVES


VERSION = 1
#: Lines of a file of a dump, and parts whose files' digests are put together.
FILE_LINES, FILES_A_NODE = 50_000, 1_000


def sections(memories: DataFrame, entities: DataFrame, relations: DataFrame, user_id: str | None = None) -> dict[str, DataFrame]:
    """What a dump holds, of one user or of all."""
    found = {"memories": memories.where("deleted_at IS NULL"), "entities": entities, "relations": relations.where("deleted_at IS NULL")}
    return {k: v.where(F.col("user_id") == user_id) if user_id is not None else v for k, v in found.items()}


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """section and number of rows of each part of a dump."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def stamp(now: datetime) -> str:
    return now.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def iso(ts: Column) -> Column:
    """A time to the second, as text with a Z."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lines(parts: dict[str, DataFrame]) -> DataFrame:
    """section, id and the row as JSON: a distributed form of a dump's contents."""
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("section"), "id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
        out = row if out is None else out.unionByName(row)
    return out


def dump(spark: SparkSession, parts: dict[str, DataFrame], root: str, now: datetime, user_id: str | None = None) -> DataFrame:
    """Write a dump as JSON lines by section, in the order of ids, and return its catalogue row.

    A section `header` names version, dumped_at and user_id. The checksum is that of checksum().
    """
    uri = f"{root.rstrip('/')}/dump_{stamp(now)}_{user_id or 'all'}.json"
    header = spark.createDataFrame([("header", "header", VERSION, user_id)], "section string, id string, version int, user_id string")
    header = header.select("section", "id", F.to_json(F.struct("version", F.lit(now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("dumped_at"), "user_id"), {"ignoreNullFields": "false"}).alias("json"))
    own = lines(parts).unionByName(header).repartitionByRange("section", "id").sortWithinPartitions("section", "id", "json")
    own.write.mode("errorifexists").option("maxRecordsPerFile", FILE_LINES).partitionBy("section").json(uri)
    found = {r["section"]: r["n"] for r in spark.read.schema("id string, json string, section string").json(uri).groupBy("section").agg(F.count("*").alias("n")).collect()}
    n = lambda k: found.get(k, 0)
    name = "l3_" + hashlib.sha256(uri.encode()).hexdigest()[:32]
    return spark.createDataFrame([(name, uri, checksum(spark, uri), n("memories"), n("entities"), n("relations"), now)], ARCHIVES)


def checksum(spark: SparkSession, uri: str) -> str:
    """SHA-256 of a dump's bytes, as a tree: of each file where it is read, of FILES_A_NODE files in their order, of those.

    Files have FILE_LINES lines at most, so each is small enough for a row; the driver sees a digest for so many files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(uri)
    piece = lambda i: F.regexp_extract("path", r"/section=([^/]+)/part-(\d+)-[^/]*?c(\d+)\.json$", i)
    own = files.select(piece(1).alias("section"), piece(2).cast("long").alias("part"), piece(3).cast("long").alias("file"), F.sha2("content", 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "file", "digest"))), lambda x: x["digest"])
    nodes = own.groupBy("section", F.floor(F.col("part") / FILES_A_NODE).alias("node")).agg(F.sha2(F.array_join(ordered, ":"), 256).alias("digest"))
    body = ";".join(f"{r['section']}:{r['node']}:{r['digest']}" for r in nodes.orderBy("section", "node").collect())
    return hashlib.sha256(body.encode()).hexdigest()


def document(parts: dict[str, DataFrame], now: datetime, user_id: str | None = None) -> DataFrame:
    """One row with the dump as a single JSON document, for the few rows of one user."""
    arrays = []
    for name, df in parts.items():
        arrays.append(df.agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("k"), F.struct("*").alias("row")))).alias("a")).select(F.transform("a", lambda x: x["row"]).alias(name)))
    joined = arrays[0]
    for more in arrays[1:]:
        joined = joined.crossJoin(more)  # one row each
    at = now.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(at).alias("dumped_at"), F.lit(user_id).alias("user_id"), *parts), {"pretty": "true", "ignoreNullFields": "false"})
    return joined.select(body.alias("json")).withColumn("checksum", F.sha2("json", 256))


def latest(archives: DataFrame, limit: int = 20) -> DataFrame:
    return archives.orderBy(F.desc("created_at"), "id").limit(limit)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Sorted paths of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path").orderBy("path")
