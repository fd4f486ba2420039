"""Substring search through an index of trigrams.

Each text's distinct runs of three characters (with two blanks of a kind of their own after the end, so every character begins
one) are postings, kept as lists of ids by slices of some megabytes of text. A text that holds a needle holds all the needle's trigrams: the rarest of them gives the candidates, and only
those texts are searched. Needles of one or two characters take the trigrams that begin with them. Nothing is left out: the
answer is that of searching every text. Null texts and needles hold nothing; the empty needle is in every text that isn't null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.text import slices
from mnemos.functions.vector import small
from mnemos.sources.scratch import checkpoint_root, kept

END = "\x03\x03"
#: Texts are stored in so many folders by a hash of their ids; candidates of few folders leave the others unread.
FOLDERS = 64
#: Bytes of text whose postings make one list a trigram.
SLICE = 4 << 20


def _folder(id: Column) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(FOLDERS)).cast("int")


def _listed(texts: DataFrame) -> DataFrame:
    """(gram, ids): for each slice of the texts its distinct trigrams and the ids of the texts that have them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own in slices(batch.column(1), SLICE):
                codes = []
                for text in own:
                    c = np.frombuffer((text + END).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                    codes.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
                rows, code = np.repeat(np.arange(len(own)), [len(x) for x in codes]), np.concatenate(codes)
                order = np.argsort(code, kind="stable")
                grams, starts = np.unique(code[order], return_index=True)
                points = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype(np.uint32)
                joined = points.tobytes().decode("utf-32-le", "surrogatepass")
                ids = batch.column(0).take(pa.array(at + rows[order]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([joined[3 * i : 3 * i + 3] for i in range(len(grams))], pa.string()), lists], ["gram", "ids"])

    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType))])
    return texts.select("id", "text").mapInArrow(made, schema)


class TrigramIndex:
    """Postings (gram, ids), their numbers, and the texts."""

    def __init__(self, texts: DataFrame, postings: DataFrame, sizes: DataFrame):
        self.texts, self.postings, self.sizes = texts, postings, sizes

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, text: Column, path: str | None = None) -> TrigramIndex:
        """rows: ids and texts; text: what is searched, such as a lower-cased column. path: where the tables are written."""
        texts = rows.select(F.col(id_col).alias("id"), text.alias("text")).where("text IS NOT NULL").withColumn("folder", _folder(F.col("id")))
        spark, folders = rows.sparkSession, [] if path is None else ["folder"]
        path = path or f"{checkpoint_root(spark)}/trigrams-{uuid.uuid4().hex}"
        texts.write.partitionBy(*folders).parquet(f"{path}/texts")
        texts = spark.read.schema(texts.schema).parquet(f"{path}/texts")
        postings = _listed(texts.where("text <> ''"))
        postings.write.parquet(f"{path}/postings")
        postings = spark.read.schema(postings.schema).parquet(f"{path}/postings")
        return cls(texts, postings, kept(postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))))

    def candidates(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """(needle, id, folder) of the texts that may hold each distinct needle, out of the postings of its rarest trigram."""
        asked = needles.select(F.col(needle).alias("needle")).where("needle IS NOT NULL AND needle <> ''").distinct()
        long = asked.where(F.length("needle") >= 3)
        grams = long.select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("needle") - 2), lambda i: F.substring("needle", i, F.lit(3))))).alias("gram"))
        # A trigram that no text has leaves the needle without candidates.
        met = grams.join(self.sizes, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
        short = asked.where(F.length("needle") < 3)
        begun = self.sizes.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("needle")).distinct()
        picked = met.unionByName(short.join(begun, "needle").select("needle", "gram"))
        return self.postings.join(small(kept(picked)), "gram").select("needle", F.explode("ids").alias("id")).distinct().withColumn("folder", _folder(F.col("id")))

    def containing(self, needles: DataFrame, needle: str = "needle") -> DataFrame:
        """(needle, id) of every distinct needle and the texts that hold it."""
        found = kept(self.candidates(needles, needle))
        folders = [r["folder"] for r in found.select("folder").distinct().collect()]  # FOLDERS at most
        held = self.texts.where(F.col("folder").isin(folders)).join(found, ["folder", "id"]).where(F.contains("text", F.col("needle"))).select("needle", "id")
        if needles.where(F.col(needle) == "").isEmpty():
            return held
        return held.unionByName(self.texts.select(F.lit("").alias("needle"), "id"))
