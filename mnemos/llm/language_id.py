"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (the byte pieces of a rank file). A word,
with a blank before it, can be cut into pieces in many ways; its probability is the sum over all of them, which a
forward pass gives in one sweep. A text's score is the sum of its words' log probabilities, and the language with the
highest wins; the reported score is its share of the languages' likelihoods. Piece probabilities come from expectation
maximisation (forward-backward) over the words of labelled texts.

Words are runs of letters of the lower-cased text (ASCII digits and punctuation part them); longer runs than 64 bytes,
as in scripts without blanks, are cut into words between characters, in the fit as in scoring. A text that is null or has
no letter is `und` with score 0, as is every text if nothing was learned (empty table, no labels). Whole texts are
read, of any length; where products of probabilities could leave the range of numbers, logarithms are summed. Repeated rows are scored alike; ties go to the language
that sorts first. Labels, sources and ids play no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.llm.byte_bpe import parse_ranks
from mnemos.llm.common import WORD_TABLE, bound_batches, free_name, materialise, release, resident, slices, trim, vocabulary_bytes

#: As the words' table, with digits as separators too.
LETTER_TABLE = bytes(32 if 48 <= b <= 57 else b for b in WORD_TABLE)
#: Longer runs of letters are cut into words of so many bytes at most, between characters.
WORD_BYTES = 64
#: Words whose lattices are in memory at a time, times the languages.
LATTICES = 32_768
#: Products of probabilities stay above e to the minus this.
RANGE = 690.0
#: Words that a Python worker remembers, and the bits that tell whether one was met.
CACHE_ENTRIES = 200_000
MET_MASK = (1 << 22) - 1


def _cut(word: bytes) -> Iterator[bytes]:
    at = 0
    while len(word) - at > WORD_BYTES:
        end = at + WORD_BYTES
        while word[end] & 0xC0 == 0x80:
            end -= 1
        yield word[at:end]
        at = end
    yield word[at:]


def letter_words(text: str) -> list[bytes]:
    """The words of a lower-cased text in UTF-8."""
    own = text.lower().encode("utf-8", "surrogatepass").translate(LETTER_TABLE).split()
    if own and max(map(len, own)) > WORD_BYTES:
        return [x for w in own for x in _cut(w)]
    return own


class Lattice:
    """The pieces of a vocabulary that words can hold, as a table of transitions from byte to byte."""

    def __init__(self, pieces: list[bytes]):
        letters = [*range(97, 123), *range(128, 256)]
        self.column = np.zeros(256, np.uint8)  # 0: none
        self.column[[32, *letters]] = np.arange(1, len(letters) + 2)
        states: dict[bytes, int] = {b"": 1}  # 0: dead
        known = bytes([32, *letters])
        for p in pieces:
            if p and not p.strip(known) and b" " not in p[1:]:
                for n in range(1, len(p) + 1):
                    states.setdefault(p[:n], len(states) + 1)
        self.step = np.zeros((len(states) + 1, len(letters) + 2), np.int32)
        self.piece = np.full(len(states) + 1, -1, np.int32)
        for p, state in states.items():
            if p:
                self.step[states[p[:-1]], self.column[p[-1]]] = state
        for i, p in enumerate(pieces):
            if p in states and p:
                self.piece[states[p]] = i

    def cuts(self, words: list[bytes], languages: int) -> Iterator[tuple[np.ndarray, Cuts]]:
        """The words in groups of like lengths: their places in the list, and their cuts."""
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")[::-1]
        size = max(1, LATTICES // max(1, languages))
        for at in range(0, len(order), size):
            own = order[at : at + size]
            yield own, Cuts(self, [words[i] for i in own.tolist()])


class Cuts:
    """All ways to cut words, longest first and each with a blank before it, into pieces; sums over all of them."""

    def __init__(self, lattice: Lattice, words: list[bytes]):
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.zeros((len(words), int(lengths[0]) + 1 if len(words) else 1), np.uint8)
        codes[:, 0] = lattice.column[32]
        codes[:, 1:][np.arange(codes.shape[1] - 1) < lengths[:, None]] = lattice.column[np.frombuffer(b"".join(words), np.uint8)]
        codes = np.ascontiguousarray(codes.T)
        self.last, self.all = lengths + 1, np.arange(len(words))
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, end, words, pieces; by start
        for i in range(len(codes)):
            rows = self.all[: np.searchsorted(-lengths, -i, side="right")]
            state = np.ones(len(rows), np.int32)
            for j in range(i, len(codes)):
                state = lattice.step[state, codes[j][rows]]
                alive = state > 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = lattice.piece[state]
                own = piece >= 0
                if own.any():
                    self.edges.append((i, j + 1, rows[own], piece[own]))

    def _logs(self, prob: np.ndarray) -> bool:
        """Whether products would leave the range of numbers, so logarithms are summed instead."""
        return float(self.last.max(initial=0)) * -np.log(max(prob.min(initial=1.0), 1e-300)) > RANGE

    def _forward(self, p: np.ndarray, logs: bool) -> np.ndarray:
        alpha = np.full((int(self.last.max(initial=0)) + 1, len(self.all), p.shape[1]), -np.inf if logs else 0.0)
        alpha[0] = 0 if logs else 1
        for i, j, rows, piece in self.edges:
            more = alpha[i][rows] + p[piece] if logs else alpha[i][rows] * p[piece]
            alpha[j][rows] = np.logaddexp(alpha[j][rows], more) if logs else alpha[j][rows] + more
        return alpha

    def log_probs(self, prob: np.ndarray) -> np.ndarray:
        """Log probabilities of the words in each language."""
        logs = self._logs(prob)
        with np.errstate(divide="ignore"):
            total = self._forward(np.log(prob) if logs else prob, logs)[self.last, self.all]
            return np.maximum(total if logs else np.log(total), -1e6)

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for counts of each word in each language."""
        logs = self._logs(prob)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.log(prob) if logs else prob
            alpha = self._forward(p, logs)
            total = alpha[self.last, self.all]
            beta = np.full(alpha.shape, -np.inf if logs else 0.0)
            beta[self.last, self.all] = 0 if logs else 1
            weight = np.where((counts > 0) & (total > (-np.inf if logs else 0)), counts if logs else counts / total, 0)
            places, uses = [np.zeros(0, np.int64)], [np.zeros((0, prob.shape[1]))]
            for i, j, rows, piece in reversed(self.edges):
                behind = p[piece] + beta[j][rows] if logs else p[piece] * beta[j][rows]
                beta[i][rows] = np.logaddexp(beta[i][rows], behind) if logs else beta[i][rows] + behind
                used = np.exp(alpha[i][rows] + behind - total[rows]) if logs else alpha[i][rows] * behind
                places.append(piece)
                uses.append(np.where(weight[rows] > 0, used * weight[rows], 0))
        place, use = np.concatenate(places), np.concatenate(uses)
        return np.stack([np.bincount(place, use[:, k], len(prob)) for k in range(prob.shape[1])], axis=1)


def expectation(lattice: Lattice, words: list[bytes], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of the pieces (pieces x languages) in words with counts (words x languages)."""
    total = np.zeros_like(prob)
    for own, cuts in lattice.cuts(words, prob.shape[1]):
        total += cuts.expected(prob, counts[own])
    return total


def maximised(uses: np.ndarray, smoothing: float) -> np.ndarray:
    """Probabilities out of uses; every piece keeps a little, so no text is impossible."""
    return (uses + smoothing) / (uses + smoothing).sum(axis=0)


def _lattice(ranks: bytes) -> Lattice:
    return resident("lattice", ranks, lambda: Lattice(parse_ranks(ranks)))


def learn(table: DataFrame, langs: list[str], ranks: bytes, rounds: int, smoothing: float) -> np.ndarray:
    """Piece probabilities by language out of a table of words and their counts in each language (n_0, n_1, ...).

    Each round sends the probabilities out and gets the expected uses back: pieces x languages numbers, summed on the
    executors.
    """
    spark, size = table.sparkSession, len(parse_ranks(ranks))
    prob = np.full((size, len(langs)), 1 / size)
    names = [f"n_{k}" for k in range(len(langs))]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((ranks, prob))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_ranks, own_prob = shared.value
            lattice = _lattice(own_ranks)
            uses = np.zeros_like(own_prob)
            for batch in batches:
                counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.float64)
                uses += expectation(lattice, batch.column(0).to_pylist(), counts, own_prob)
            met = np.flatnonzero(uses.any(axis=1))
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *[pa.array(uses[met, k]) for k in range(uses.shape[1])]], ["piece", *names])

        schema = "piece int, " + ", ".join(f"{n} double" for n in names)
        sums = table.mapInArrow(step, schema).groupBy("piece").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        uses = np.zeros_like(prob)
        uses[sums["piece"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
        prob = maximised(uses, smoothing)
        shared.unpersist()
    return prob


class Scorer:
    """Scores texts by a model and remembers the words that come again."""

    def __init__(self, pieces: list[bytes], prob: np.ndarray, langs: list[str]):
        self.lattice, self.prob, self.langs = Lattice(pieces), prob, langs
        self.rows: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(langs)))
        self.met = bytearray(MET_MASK + 1)

    def _log_probs(self, new: list[bytes]) -> np.ndarray:
        out = np.zeros((len(new), len(self.langs)))
        for own, cuts in self.lattice.cuts(new, len(self.langs)):
            out[own] = cuts.log_probs(self.prob)
        return out

    def _forget(self, new: list[bytes], base: int, logs: np.ndarray) -> None:
        """Keeps, of a slice's new words, those that another slice had before; one bit each tells."""
        kept = []
        for i, w in enumerate(new):
            at = hash(w) & MET_MASK
            if self.met[at]:
                kept.append(i)
            else:
                self.met[at] = 1
                del self.rows[w]
        if base + len(kept) > CACHE_ENTRIES:  # the frequent ones came first
            base = min(base, CACHE_ENTRIES // 2)
            self.rows, kept = {w: i for w, i in self.rows.items() if i < base}, []
        self.logs = np.concatenate([self.logs[:base], logs[kept]])
        self.rows.update((new[i], base + k) for k, i in enumerate(kept))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [letter_words(x) for x in texts]
        rows, base = self.rows, len(self.logs)
        new = [w for w in set(chain.from_iterable(parts)) if w not in rows]
        logs = self._log_probs(new)
        rows.update(zip(new, range(base, base + len(new)), strict=True))
        table = np.concatenate([self.logs, logs])
        names, shares = [], []
        get = rows.__getitem__
        for text, own in zip(texts, parts, strict=True):
            if not own or not any(map(str.isalpha, text)):
                names.append("und")
                shares.append(0.0)
                continue
            total = table[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            shares.append(float(1 / np.exp(total - total[best]).sum()))
        self._forget(new, base, logs)
        return names, shares


def _scorer(ranks: bytes, prob: bytes, langs: tuple[str, ...]) -> Scorer:
    def build() -> Scorer:
        pieces = parse_ranks(ranks)
        return Scorer(pieces, np.frombuffer(prob).reshape(len(pieces), len(langs)), list(langs))

    return resident("scorer", (ranks, prob, langs), build)


class LanguageModel:
    """Piece probabilities by language over the pieces of a rank file."""

    def __init__(self, ranks: bytes, langs: list[str], prob: np.ndarray):
        self.ranks, self.langs, self.prob = ranks, langs, prob

    def predict(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
        """docs with the predicted language and its score, row by row, without a shuffle.

        The model that goes to the executors has pieces x languages numbers, whatever the corpus' size.
        """
        bound_batches(docs.sparkSession)
        lang_col, score_col = free_name(docs.columns, lang_col), free_name(docs.columns, score_col)
        if not self.langs:
            return docs.withColumn(lang_col, F.lit("und")).withColumn(score_col, F.lit(0.0))
        shared = docs.sparkSession.sparkContext.broadcast((self.ranks, self.prob.tobytes(), tuple(self.langs)))

        @F.arrow_udf("struct<lang: string, score: double>")
        def predicted(texts: pa.Array) -> pa.Array:
            own = _scorer(*shared.value)
            names: list[str] = []
            shares: list[float] = []
            for _, part in slices(texts, 2 << 20):
                a, b = own.score(part)
                names += a
                shares += b
            trim()
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang", "score"])

        made = free_name(docs.columns, "predicted")
        out = docs.withColumn(made, predicted(F.col(text_col).cast("string")))
        return out.withColumn(lang_col, F.col(made)["lang"]).withColumn(score_col, F.col(made)["score"]).drop(made)


def fit(
    docs: DataFrame,
    learnable: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    key: Column | None = None,
    vocabulary: str | None = None,
    sample_bytes: int = 4 << 20,
    rounds: int = 4,
    smoothing: float = 0.1,
) -> LanguageModel:
    """A model of the languages of docs that are `learnable` and have a label.

    The fit takes about sample_bytes of text of each language (a bound: a hash of `key` picks the documents, whole). Their
    distinct words are counted and fitted on the executors; the driver sees the piece probabilities only.
    """
    bound_batches(docs.sparkSession)
    ranks = vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    key = F.col("doc_id") if key is None else key
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("lot"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel(ranks, [], np.zeros((0, 0)))
    picked = F.lit(False)
    for lang in langs:
        picked = picked | ((F.col("lang") == lang) & (F.col("lot") < int(min(1.0, sample_bytes / max(1, sizes[lang])) * (1 << 20))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        release()
        for batch in batches:
            names, totals = batch.column(0).to_pylist(), Counter()
            for at, texts in slices(batch.column(1), 1 << 20):
                for lang, text in zip(names[at:], texts, strict=False):
                    totals.update((lang, w) for w in letter_words(text))
            if totals:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in totals]), "word": pa.array([k[1] for k in totals], pa.binary()), "n": pa.array(list(totals.values()), pa.int64())})

    counts = rows.where(picked).select("lang", "text").mapInArrow(counted, "lang string, word binary, n long")
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n_{k}") for k, lang in enumerate(langs)]
    table = materialise(counts.groupBy("word").agg(*sums), "words")
    return LanguageModel(ranks, langs, learn(table, langs, ranks, rounds, smoothing))


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = model.predict(docs.select("doc_id", "text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
