"""A training corpus out of raw documents, in five stages.

Language identification, line deduplication, near-duplicate removal, benchmark decontamination, encoding. Each stage takes
(spark, docs, sf_dir) and works on all that the one before kept; its result is written as Parquet and read again. All but
the last return the columns of documents, further ones included; n_chars follows a changed text. Names of the stages' own
columns give way to columns that documents have. Empty tables stay empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import byte_bpe, decontamination, language_id, line_dedup, near_dedup
from mnemos.llm.common import discard, free_name, keyed, materialise, sided

#: A document whose best language has less than this share of the likelihood is rejected.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, and those that no language fits clearly, go.

    Null and empty texts have no letters and go; repeated rows are judged alike; ties go to the language that sorts first.
    Null labels aren't learned from; without any label nothing is learned and all documents go.
    """
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    found = model.predict(docs, lang_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or the same one above, has alike or nearly so.

    Null texts stay null, empty ones empty; a document stays if it loses all its lines. Of rows with the same id (or none)
    the one that is read first is the earlier one, so repeated rows lose all their lines to it.
    """
    lost = free_name(docs.columns, "n_dropped")
    out = line_dedup.dedup(docs, dropped_col=lost, exact_chars=line_dedup.EXACT_CHARS)
    return out.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near duplicates.

    Null texts and texts without words are one class, of which one stays; of repeated rows one stays. Where ids repeat or
    are null, the row that is read first counts as the smallest of its class.
    """
    key = free_name(docs.columns, "row_key")
    rows = keyed(docs, "doc_id", key)
    classes = near_dedup.keyed_classes(rows.select(F.col(key).alias("row_key"), "doc_id", "text"), "doc_id", "text")
    gone = materialise(classes.where(~F.col("kept")).select(F.col("row_key").alias(key)), "near-duplicates")
    return rows.join(sided(gone, near_dedup.BROADCAST_ROWS), key, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth.

    Null and empty texts have no passages and stay; repeated rows are judged alike; an empty benchmark leaves all.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = free_name(docs.columns, "hits")
    found = decontamination.find(docs, benchmark, hits_col=hits)
    return found.where(~decontamination.contaminated(F.col(hits))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to.

    Null and empty texts have no ids; repeated rows stay. Columns other than doc_id, lang and source end here.
    """
    out = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "ids", *byte_bpe.digests(out))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: SQL can't express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; what a stage replaces goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
