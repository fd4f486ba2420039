"""What the training-data operators share: scratch tables, row keys, bounded batches, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.text import SLICE_BYTES, slices  # noqa: F401

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local master may leave it unset (tests): a fresh temporary folder is then set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="mnemos-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's own folder below the shared one."""
    return f"{scratch_root(spark)}/mnemos/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote between their steps; results not written elsewhere go with it."""
    drop_path(spark, f"{scratch_root(spark)}/mnemos/{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() made, as soon as nothing reads them any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, folder)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in memory."""
    total = F.lit(16)
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            total = total + F.greatest(F.size(c), F.lit(0)) * 8 + 24
        else:
            total = total + (8 if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.length(F.to_json(F.struct(c))))
    return total.cast("long")


def sided(table: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A written table, marked to be broadcast if its rows and their bytes, both counted, stay within the bounds."""
    n, size = table.agg(F.count("*"), F.sum(_row_bytes(table))).first()
    return F.broadcast(table) if n <= most_rows and (size or 0) <= most_bytes else table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that a few thousand long texts don't meet in one; a set bound stays."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(most))


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with underscores before it until no column (of any case) has it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def keyed(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """docs with a non-null long column `key`, one value a row and the same in every scan.

    Distinct non-null integer ids serve as they are. Otherwise (repeated rows, null or other ids) the rows are
    written once with a number each and read back: a number that is made anew in each scan could differ.
    """
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole:
        odd = docs.groupBy(F.col(id_col).alias("k")).count().where("k IS NULL OR count > 1")
        if odd.isEmpty():
            return docs.withColumn(key, F.col(id_col).cast("long"))
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def _word_table() -> bytes:
    table = bytearray(b" " * 256)
    for i in range(256):
        if i >= 128 or chr(i).isdigit() or chr(i).isalpha():
            table[i] = i + 32 if 65 <= i <= 90 else i
    return bytes(table)


#: Maps UTF-8 bytes so that split() gives the words: digits, letters (A-Z lower-cased), all beyond ASCII.
WORD_TABLE = _word_table()


def words(text: str) -> list[bytes]:
    """Words in UTF-8: runs of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def vocabulary_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, read on the driver; its size is checked since it goes to every executor."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of what words() gives."""
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


_RESIDENT: dict[str, tuple[object, object]] = {}


def resident(kind: str, key: object, build):
    """What build() makes for a key, kept in the Python worker until another kind or key is asked for.

    Workers serve one operator after another; only the last one's vocabulary and caches stay in memory.
    """
    held = _RESIDENT.get(kind)
    if held is None or held[0] != key:
        _RESIDENT.clear()
        held = None
        trim()
        _RESIDENT[kind] = held = (key, build())
    return held[1]


def release() -> None:
    """Drop what resident() keeps: a worker that begins another operator's work needs none of it."""
    _RESIDENT.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system where the C library can: workers that wait keep little."""
    import ctypes

    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)
