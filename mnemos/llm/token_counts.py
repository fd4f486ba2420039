"""Token counts as rollups that are maintained by signed deltas.

Totals by source, language and tokenizer version are sums, so a change needs no recount: an insert adds a document and its
tokens, a delete subtracts them, and a revised count subtracts the old and adds the new one. A batch of changes is summed up
by key (with a map-side combine, so a hot source costs a row a task) and written under its id; it is committed once Spark's
committer has put its success mark there. A batch whose mark is there is not applied again, and what a failed attempt left
is overwritten, so commits may be repeated at will. Totals add up the committed batches; compact() folds them into one
version, which names the batches that it holds.

Null sources, languages and versions are keys of their own. Null and empty texts have no tokens but count as documents, as
does every repeated row. Keys whose sums are all 0 are left out. Without batches, or with empty ones, totals are empty.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm.byte_bpe import codec
from mnemos.llm.common import bound_batches, drop_path, free_name, materialise, path_exists, scratch_path, vocabulary_bytes
from mnemos.llm.pretokens import text_slices

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, text_col: str = "text", count_col: str = "n_tokens", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with the number of byte-level BPE tokens of each whole text; row by row, without a shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        own = codec(ranks.value, pattern)
        parts = [np.diff(own.encode(part)[1]) for part in text_slices(texts)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())

    return docs.withColumn(free_name(docs.columns, count_col), counted(F.col(text_col).cast("string")))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes for new documents: source, lang, tokenizer and n_tokens of each."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Changes for documents that go, with the counts that they went in with."""
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes for documents whose key or count is another now."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _marked(self, folder: str) -> bool:
        return path_exists(self.spark, f"{self.path}/{folder}/_SUCCESS")

    def _names(self, folder: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in system.listStatus(hadoop)) if system.exists(hadoop) else []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if a batch of that id was committed before, whatever is in this one."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError("a batch id is made of letters, digits and hyphens")
        if self._marked(f"batches/{batch}") or self._inside([batch]):
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _version(self) -> int:
        """The newest whole version (0: none)."""
        whole = (int(n) for n in reversed(self._names("versions")) if self._marked(f"versions/{n}/batches") and self._marked(f"versions/{n}/totals"))
        return next(whole, 0)

    def _held(self, version: int) -> DataFrame:
        """Ids of the batches in a version."""
        read = self.spark.read.schema("batch string")
        return read.parquet(f"{self.path}/versions/{version:08d}/batches") if version else self.spark.createDataFrame([], "batch string")

    def _inside(self, batches: list[str]) -> set[str]:
        """Those of the open batches that the newest version holds."""
        version = self._version()
        if not version or not batches:
            return set()
        asked = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        return {r["batch"] for r in self._held(version).join(asked, "batch", "left_semi").collect()}

    def _open(self) -> list[str]:
        """Committed batches that no version holds."""
        marked = [b for b in self._names("batches") if self._marked(f"batches/{b}")]
        inside = self._inside(marked)
        return [b for b in marked if b not in inside]

    def committed(self) -> DataFrame:
        """Ids of all committed batches."""
        more = self.spark.createDataFrame([(b,) for b in self._open()], "batch string")
        return self._held(self._version()).unionByName(more)

    def totals(self) -> DataFrame:
        version = self._version()
        folders = [f"{self.path}/versions/{version:08d}/totals"] if version else []
        folders += [f"{self.path}/batches/{b}" for b in self._open()]
        read = self.spark.read.schema(TOTALS)
        rows = read.parquet(*folders) if folders else self.spark.createDataFrame([], TOTALS)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> int:
        """Fold all committed batches into a new version; their folders go once it is whole."""
        version, folded = self._version(), self._open()
        at = f"{self.path}/versions/{version + 1:08d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        self.committed().write.mode("overwrite").parquet(f"{at}/batches")
        for b in folded:
            drop_path(self.spark, f"{self.path}/batches/{b}")
        return version + 1


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents go in, labelled toxic ones go out, and those of good quality are counted

    anew with an end token (a version of its own); the first batch comes twice.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    counts = materialise(count_tokens(docs).drop("text").withColumn("tokenizer", F.lit("byte_bpe_50k")), "counts")
    labelled = counts.join(labels, "doc_id")
    good = labelled.where("quality = 1 AND NOT coalesce(toxic, 0) = 1")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("1-insert", inserts(counts))
    rollup.commit("2-delete", deletes(labelled.where("toxic = 1")))
    rollup.compact()
    rollup.commit("3-revise", revisions(good, good.withColumn("tokenizer", F.lit("byte_bpe_50k-end")).withColumn("n_tokens", F.col("n_tokens") + 1)))
    rollup.commit("1-insert", inserts(counts))
    return rollup.totals()
