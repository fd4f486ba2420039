"""Source divergence audit: how far each source's terms are from those of the other sources, and of all, in its language.

Terms that fewer than `least_docs` documents of a language have play no part, and most distinct terms are such. A first pass
over the texts counts document frequencies in count-min sketches, one a task, whose cells stop at `least_docs`; cells are
summed over the tasks by blocks. A sketch never underestimates, so a second pass drops the terms it calls too rare before
anything is shuffled. What survives is counted exactly, and rare terms that only collisions kept go then.

With V kept terms of a language and N occurrences of them in a group, a term with n of them has
p = 1 + floor(10^9 (n + 1) / (N + V)), in whole numbers; f(p, q) = floor((p - q)^2 / q) is how much it stands out. A source
pair's value is the sum of f over all V terms. Most terms are in few sources, so it is taken apart: f of two absent terms
times V, corrected for the terms of either source by way of the histogram of their counts, and for terms of both by a join of
the sparse counts with themselves on the term. No table of sources times terms is made.

Null texts, languages and sources count as ''. Each row is a document, repeated rows too. Terms are runs of ASCII letters
(lower-cased) and of characters beyond ASCII, in whole texts of any length. A group without terms takes part; without kept
terms a language's pairs have value 0. Ties go to the item that sorts first in UTF-8. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from mnemos.llm.common import bound_batches, discard, materialise, sided, trim

#: Maps UTF-8 bytes so that split() gives the terms.
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DEPTH = 3
#: Bounds of a sketch row's cells; between them there is one for every so many bytes of text.
LEAST_CELLS, MOST_CELLS, BYTES_A_CELL = 1 << 16, 1 << 22, 64
#: Cells that are summed together, and terms that are added at once (their counts stay within 16 bits).
BLOCK, AT_ONCE = 1 << 16, 16_384
#: Distinct terms that a task counts before it hands the counts on.
HELD_TERMS = 300_000
SCALE = 1_000_000_000
MOST_RANKS = 200


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_TABLE).split()


def _places(lang: str, words: list[bytes], cells: int) -> np.ndarray:
    """DEPTH cells of each word of a language, in DEPTH rows of `cells` cells."""
    seed = xxh3_64_intdigest(lang.encode())
    pair = np.frombuffer(b"".join([xxh3_128_digest(w, seed=seed) for w in words]), np.uint64).reshape(-1, 2)
    rows = np.arange(DEPTH, dtype=np.uint64)[:, None]
    return ((pair[:, 0] + rows * (pair[:, 1] | np.uint64(1))) % np.uint64(cells) + rows * np.uint64(cells)).astype(np.int64)


class Sketch:
    """Document frequencies that stop at `most`."""

    def __init__(self, cells: int, most: int):
        self.cells, self.most = cells, most
        self.table = np.zeros(DEPTH * cells, np.uint16)

    def add(self, lang: str, counts: Counter) -> None:
        words, numbers = list(counts), np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), self.most).astype(np.uint16)
        for at in range(0, len(words), AT_ONCE):
            for row in _places(lang, words[at : at + AT_ONCE], self.cells):
                np.add.at(self.table, row, numbers[at : at + AT_ONCE])
                self.table[row] = np.minimum(self.table[row], self.most)


class Frequent:
    """Tells which terms may have reached the least document frequency: one bit a cell."""

    def __init__(self, bits: bytes, cells: int):
        self.cells, self.bits = cells, np.frombuffer(bits, np.uint8)

    def possible(self, lang: str, words: list[bytes]) -> np.ndarray:
        out = np.ones(len(words), bool)
        for at in range(0, len(words), AT_ONCE):
            for row in _places(lang, words[at : at + AT_ONCE], self.cells):
                out[at : at + AT_ONCE] &= (self.bits[row >> 3] >> (row & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The texts one after the other, nulls as empty ones: a batch is never copied as a whole."""
    return (x.as_py() or b"" for x in column)


def _sketched(rows: DataFrame, cells: int, least_docs: int) -> bytes:
    """Bits of the cells that reached least_docs in the merged sketch of all rows (lang, source, text)."""
    block = min(BLOCK, cells)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(cells, least_docs)
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
                counts[lang].update(set(terms(text)))
            for lang, c in counts.items():
                own.add(lang, c)
        for k, part in enumerate(own.table.reshape(-1, block)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "cells": pa.array([part.astype(np.uint8).tobytes()], pa.binary())})
        trim()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(part.as_py(), np.uint8)
                total[k] = np.minimum(total[k].astype(np.uint16) + new, least_docs).astype(np.uint8) if k in total else new
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "cells": pa.array([np.packbits(part >= least_docs, bitorder="little").tobytes()], pa.binary())})

    schema = "block int, cells binary"
    parts = rows.mapInArrow(sketch, schema).repartition("block").mapInArrow(merge, schema).toArrow()
    bits = np.zeros(DEPTH * cells // 8, np.uint8)
    for k, part in zip(parts["block"].to_pylist(), parts["cells"].to_pylist(), strict=True):
        bits[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(part, np.uint8)
    return bits.tobytes()


def _counted(rows: DataFrame, frequent: tuple[bytes, int]) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of the terms that the sketch lets pass."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Frequent(*shared.value)
        uses: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in uses.items():
                words = list(counts)
                keep = np.flatnonzero(own.possible(lang, words)).tolist()
                for at in range(0, len(keep), 50_000):
                    part = [words[i] for i in keep[at : at + 50_000]]
                    met = docs[lang, source]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part)), "source": pa.array([source] * len(part)), "term": pa.array(part, pa.binary()),
                        "n": pa.array([counts[w] for w in part], pa.int64()), "d": pa.array([met[w] for w in part], pa.int64()),
                    })
            uses.clear()
            docs.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch.column("text")), strict=True):
                words = terms(text)
                uses[lang, source].update(words)
                docs[lang, source].update(set(words))
            if sum(map(len, uses.values())) > HELD_TERMS:
                yield from flushed()
        yield from flushed()
        trim()

    return rows.mapInArrow(count, "lang string, source string, term binary, n long, d long")


def _share(n: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact for any counts."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms_).cast("decimal(20,0)"))).cast("long")


def _f(p: str | Column, q: str | Column) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    out = out if most is None else out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources.

    kept: lang, term, source, n and p of the term in the source, p0 of absent ones there. groups: lang, source, terms, p0.
    """
    a = groups.select("lang", "source", "terms", F.col("p0").alias("a0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("source <> item")
    key = ["lang", "source", "item"]
    both_absent = pairs.select(*key, F.when(F.col("terms") > 0, F.col("terms") * _f("a0", "b0")).otherwise(0).alias("value"))
    histogram = sided(materialise(kept.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "histogram"))
    own = pairs.join(histogram, ["lang", "source"]).select(*key, (F.col("times") * (_f("p", "b0") - _f("a0", "b0"))).alias("value"))
    other = pairs.join(histogram.select("lang", F.col("source").alias("item"), "p", "times"), ["lang", "item"]).select(*key, (F.col("times") * (_f("a0", "p") - _f("a0", "b0"))).alias("value"))
    left = kept.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = kept.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    joined = left.join(right, ["lang", "term"]).where("a < b")
    change = lambda p, p0, q, q0: F.sum(_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
    met = joined.groupBy("lang", "a", "b").agg(change("pa", "a0", "pb", "b0").alias("ab"), change("pb", "b0", "pa", "a0").alias("ba"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    both = met.select("lang", F.inline(ways)).select(*key, "value")
    return both_absent.unionAll(own).unionAll(other).unionAll(both).groupBy(*key).agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, ranks: int = MOST_RANKS, cells: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source of the language, `term` rows for the terms

    that stand out most. cells: those of a sketch row, a multiple of 8 (by default a power of two that follows the bytes
    of text, at most MOST_CELLS; more terms than cells only let more rare terms through to the exact counts).
    """
    if not 1 <= least_docs <= 255:
        raise ValueError("least_docs is 1 to 255")
    bound_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("string").cast("binary").alias("text"))
    groups = materialise(rows.groupBy("lang", "source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")), "groups")
    size = groups.agg(F.sum("size")).first()[0] or 0
    cells = cells or 1 << min(MOST_CELLS.bit_length() - 1, max(LEAST_CELLS.bit_length() - 1, (size // BYTES_A_CELL).bit_length()))
    counts = _counted(rows, (_sketched(rows, cells, least_docs), cells))
    sums = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    exact = sums.withColumn("docs", F.sum("d").over(term)).withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.min("source").over(term) == F.col("source"))
    kept = materialise(exact.where(F.col("docs") >= least_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first"), "terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("first"))
    per = materialise(groups.select("lang", "source").join(own, ["lang", "source"], "left").na.fill(0, ["total", "first"]), "totals")
    langs = materialise(per.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("terms")), "languages")
    absent = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
    known = materialise(per.select("lang", "source", "total").join(sided(langs), "lang").withColumn("p0", absent), "shares")
    few = sided(known)
    scored = kept.join(few, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    out = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    discard(groups, per, langs)
    return _ranked(_pair_values(scored.select("lang", "term", "source", "p", "p0"), few), "pair").unionAll(_ranked(out, "term", ranks))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))
