"""Toxicity by multiple-instance learning: documents are bags of sentences, of which only the bags are labelled.

A sentence's score is a logistic function of the features it holds; a document's is the noisy-or of its sentences, one minus
the product of what each leaves: one clear sentence is enough, and which ones they were comes with the score. Features are
words and beginnings of words (so that compounds and inflections count), each once a sentence, picked on labelled documents
by how often they are met in toxic ones beyond what the others give. Sentences without any picked feature are no instances
and score 0, so long clean texts don't add up to anything.

The fit takes a bounded sample of labelled rows: a hash of the text picks about sample_docs texts of each label at most, whole ones,
weighted back to their shares; equal texts are one bag. Features are counted on executors; the driver fits the weights on the
sample's bags of picked features. Everything else covers all rows. Scoring is row by row, without a shuffle.

Null and empty texts, and texts without picked features, score 0 and have no offending sentences. Repeated rows are scored
alike. Of several labels of a document the highest counts; null labels and labels without a document aren't learned from;
without toxic labels nothing is learned and all scores are 0. Whole texts are read, of any length. Of features that are
equally telling the one that sorts first is picked. Columns' names that documents have stay theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import WORD_TABLE, bound_batches, free_name, materialise, resident, sided, trim
from mnemos.llm.language_id import held_out

SENTENCE = re.compile(r"[^.!?\n。！？]+")
STOPS = [x.encode() for x in "。！？"]
#: Beginnings of so many characters are features beside whole words.
PREFIXES = range(4, 9)
SAMPLE_DOCS, FEATURES, LEAST_DOCS = 8_000, 4_096, 3
#: Distinct words that a Python worker remembers, and the longest ones of them.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
#: A document is called toxic from this score on; sentences of at least this score are reported.
LEAST_SCORE = 0.3


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *[w[:k] + "*" for k in PREFIXES if k <= len(w)]]


def words(text: bytes) -> set[bytes]:
    """Distinct words of a text in UTF-8; full stops of any script part them."""
    for stop in STOPS:
        if stop in text:
            text = text.replace(stop, b" ")
    return set(text.translate(WORD_TABLE).split())


def noisy_or(scores: Iterable[float]) -> float:
    left = 1.0
    for x in scores:
        left *= 1.0 - x
    return 1.0 - left


class Scorer:
    """Scores whole texts; remembers which words have features."""

    def __init__(self, names: list[str], weights: list[float], bias: float):
        self.ids = {n: i for i, n in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def held(self, word: bytes) -> tuple[int, ...]:
        """Features of a word that the model has."""
        own = self.known.get(word)
        if own is None:
            own = tuple(self.ids[f] for f in features(word) if f in self.ids)
            if len(word) <= CACHE_BYTES:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = own
        return own

    def instances(self, text: bytes) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, features) of the sentences that have any; code points, end exclusive."""
        held = self.held
        hot = {w for w in words(text) if held(w)}
        if not hot:
            return
        for m in SENTENCE.finditer(text.decode("utf-8", "replace")):
            own = words(m[0].encode()) & hot
            if own:
                yield m.start(), m.end(), {f for w in own for f in held(w)}

    def sentences(self, text: bytes) -> list[tuple[int, int, float]]:
        z = ((a, b, self.bias + sum(self.weights[f] for f in sorted(own))) for a, b, own in self.instances(text))
        return [(a, b, 1 / (1 + float(np.exp(-min(max(x, -500.0), 500.0))))) for a, b, x in z]


def trained(bags: list[tuple[int, list[list[int]]]], size: int, share: tuple[float, float], rounds: int = 400, rate: float = 0.1, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias that make the bags' labels likely; bags: (label, features of each sentence). share: of the label's rows that are bags."""
    doc = np.array([i for i, (_, s) in enumerate(bags) for _ in s], np.int64)
    inst = np.array([k for k, own in enumerate(x for _, s in bags for x in s) for _ in own], np.int64)
    feat = np.array([f for _, s in bags for own in s for f in own], np.int64)
    label = np.array([y for y, _ in bags], np.int64)
    weight = 1 / np.array(share)[label] if len(label) else np.zeros(0)
    weight = weight / weight.mean() if len(weight) else weight
    theta = np.append(np.ones(size), -3.0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(inst, theta[feat], len(doc))
        p = 1 / (1 + np.exp(-z))
        left = np.exp(np.bincount(doc, -np.logaddexp(0, z), len(bags)))
        pull = np.where(label == 1, -left / np.maximum(1 - left, 1e-9), 1.0) * weight
        slope = p * pull[doc]
        grad = np.append(np.bincount(feat, slope[inst], size) + ridge * theta[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


class ToxicityModel:
    """Weights of at most FEATURES features."""

    def __init__(self, names: list[str], weights: list[float], bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score", sentences_col: str = "sentences", least: float = LEAST_SCORE) -> DataFrame:
        """docs with a score of 0 to 1 and an array of the offending sentences (start, end, score), in their order."""
        bound_batches(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((tuple(self.names), tuple(self.weights), self.bias))

        @F.arrow_udf("struct<score: double, sentences: array<struct<start: int, end: int, score: double>>>")
        def scored(texts: pa.Array) -> pa.Array:
            own = resident("toxicity", shared.value, lambda: Scorer(*shared.value))
            scores, spans = [], []
            for text in texts:
                found = own.sentences(text.as_py() or b"")
                scores.append(min(1.0, max(0.0, noisy_or(s for _, _, s in found))))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if s >= least])
            trim()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], ["score", "sentences"])

        score_col, sentences_col = free_name(docs.columns, score_col), free_name(docs.columns, sentences_col)
        made = free_name(docs.columns, "scored")
        out = docs.withColumn(made, scored(F.col(text_col).cast("string").cast("binary")))
        return out.withColumn(score_col, F.col(made)["score"]).withColumn(sentences_col, F.col(made)["sentences"]).drop(made)


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, tuple[float, float]]:
    """(toxic, text) of about sample_docs texts of each label at most, and the shares of the rows that they are."""
    rows = docs.select("doc_id").join(labels, "doc_id").groupBy("toxic").count().collect()
    share = tuple(min(1.0, sample_docs / max(1, next((r["count"] for r in rows if r["toxic"] == y), 0))) for y in (0, 1))
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    wanted = docs.where(lot < int(max(share) * (1 << 20))).join(labels, "doc_id")
    wanted = wanted.where(lot < F.when(F.col("toxic") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20))))
    bags = wanted.groupBy("toxic", F.xxhash64("text").alias("lot"), F.md5("text").alias("digest")).agg(F.any_value("text").alias("text"))
    return materialise(bags, "bags"), share


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, most_features: int = FEATURES) -> ToxicityModel:
    """A model of the labels (id, label) of those documents that are learnable, a condition on the labels' rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(learnable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    known = sided(materialise(known, "labels"))
    bags, share = _sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text IS NOT NULL"), known, sample_docs)
    sizes = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return ToxicityModel([], [], 0.0)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                total: Counter = Counter()
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if label == y:
                        total.update({f for w in words(text.as_py()) for f in features(w)})
                names = list(total)
                for at in range(0, len(names), 100_000):
                    part = names[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "toxic": pa.array([y] * len(part), pa.int32()), "n": pa.array([total[f] for f in part], pa.int64())})

    counts = bags.select("toxic", "text").mapInArrow(counted, "feature string, toxic int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    ratio = (F.col("n1") / sizes[1]) / ((F.col("n0") + 0.5) / (sizes.get(0, 0) + 0.5))
    picked = counts.where((F.col("n1") >= LEAST_DOCS) & (ratio > 2)).orderBy(F.desc(F.col("n1") * F.log(ratio)), "feature").limit(most_features)
    names = [r["feature"] for r in picked.select("feature").collect()]
    if not names:
        return ToxicityModel([], [], 0.0)
    shared = spark.sparkContext.broadcast(names)

    def bagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value, [], 0.0)
        for batch in batches:
            parts = [[sorted(f) for _, _, f in own.instances(x.as_py())] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.list_(pa.int32())))], ["digest", "toxic", "parts"])

    found = bags.select("digest", "toxic", "text").mapInArrow(bagged, "digest string, toxic int, parts array<array<int>>").where("size(parts) > 0").orderBy("digest", "toxic").toArrow()
    weights, bias = trained(list(zip(found["toxic"].to_pylist(), found["parts"].to_pylist(), strict=True)), len(names), share)
    return ToxicityModel(names, [float(w) for w in weights], bias)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of those not held out; `sentences` has the offending ones as start:end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = fit(docs, labels, ~held_out(F.col("doc_id"))).score(docs)
    spans = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), spans.alias("sentences"))
