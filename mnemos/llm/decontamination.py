"""Benchmark decontamination by an FM-index of each training shard.

Phrases are windows of 13 consecutive words of a benchmark item (the whole item if it is shorter). A shard is what a task
holds of the documents at a time. Its index is built over word numbers: every word that no phrase has is one separator,
and a run of other words that is shorter than the shortest phrase is left out as a whole, since no occurrence can lie in
it - both lose nothing. Suffixes are sorted by prefix doubling; their preceding words (the Burrows-Wheeler transform) go
into a wavelet matrix with ranks, and every SAMPLE-th text position is kept. All phrases are searched backward at once,
their occurrences are located by walking to the next sampled position, and overlapping spans are merged.

Words: UTF-8 runs of ASCII digits, ASCII letters (A-Z lower-cased) and anything beyond ASCII. Null and empty texts have no
words, are hit nowhere and aren't contaminated; items without words have no window and never occur. Repeated rows are
treated alike. Whole texts of any length are indexed. Empty tables on either side leave all documents clean.

The benchmark's items are taken in blocks of bounded size, one after the other: each goes to every executor, all documents
are searched, the hits are written and the block is dropped before the next one is read. Hits of several blocks are brought
together by a row key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.llm.common import bound_batches, free_name, keyed, materialise, resident, slices, words

WINDOW = 13
SAMPLE = 8
#: Words of candidate runs that one index covers at most, but for a single longer document.
SHARD_WORDS = 1 << 19


# --- phrases ----------------------------------------------------------------------------------------------------


class Phrases:
    """Distinct windows of benchmark items, as word numbers from 1 on."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        known: dict[tuple[int, ...], int] = {}
        held: list[dict] = []  # of each phrase, its items in their order; one item may come in several rows
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                phrase = tuple(own[i : i + window])
                at = known.setdefault(phrase, len(known))
                if at == len(held):
                    held.append({})
                held[at][name] = None
        self.items: list[list] = [list(x) for x in held]
        self.lengths = np.array([len(p) for p in known], np.int64)
        self.shortest = int(self.lengths.min()) if known else 0
        self.table = np.zeros((len(known), int(self.lengths.max()) if known else 0), np.int64)
        for i, p in enumerate(known):
            self.table[i, len(self.table[i]) - len(p) :] = p  # right-aligned: searched from the end


# --- index ------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in sorted order (a suffix comes before those it begins), by prefix doubling.

    After each round only suffixes that still tie with others are sorted on.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = text[order]
    heads = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1)) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    tied = np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))
    step = 1
    while tied.any():
        places = np.flatnonzero(tied)
        own = order[places]
        ahead = own + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[own]
        sort = np.lexsort((follow, group))
        own, group, follow = own[sort], group[sort], follow[sort]
        order[places] = own
        new = np.ones(len(own), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(own)))
        rank[own] = np.repeat(places[heads], sizes)
        tied[places] = np.repeat(sizes > 1, sizes)
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a bit of the symbols, from the highest on."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol occurs before the end."""
        starts, ends = np.zeros_like(ends), ends.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbols >> b) & 1 == 1
            s1, e1 = self.ones[level][starts], self.ones[level][ends]
            starts = np.where(one, self.zeros[level] + s1, starts - s1)
            ends = np.where(one, self.zeros[level] + e1, ends - e1)
        return ends - starts

    def access(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros_like(places)
        for level in range(self.bits):
            s1 = self.ones[level][places]
            one = self.ones[level][places + 1] > s1
            places = np.where(one, self.zeros[level] + s1, places - s1)
            out = 2 * out + one
        return out


class FmIndex:
    """Backward search and location of phrases in a sequence of numbers from 0 (the separator) to `top`."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        text = np.append(text, 0) + 1
        text[-1] = 0  # an end that sorts first
        order = suffix_array(text)
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.ranks = WaveletMatrix(text[order - 1], max(1, int(top + 1).bit_length()))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each phrase's suffixes; phrases are right-aligned in table."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.size)
        alive = np.arange(len(table))
        for step in range(table.shape[1]):
            alive = alive[(high[alive] > low[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = table[alive, table.shape[1] - 1 - step] + 1
            low[alive] = self.before[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.ranks.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one is met."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            out[left[done]] = self.samples[self.sample_rank[rows[left[done]]]] + steps[left[done]]
            left = left[~done]
            symbol = self.ranks.access(rows[left])
            rows[left] = self.before[symbol] + self.ranks.rank(symbol, rows[left])
            steps[left] += 1
        return out


# --- shards -----------------------------------------------------------------------------------------------------


class Shard:
    """Documents whose candidate runs are indexed together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.n_words: list[int] = []
        self.texts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str) -> None:
        own = words(text)
        doc = len(self.n_words)
        self.n_words.append(len(own))
        least = self.phrases.shortest
        if not least or len(own) < least:
            return
        numbers = np.fromiter(map(self.phrases.vocabulary.get, own, repeat(0)), np.int64, len(own))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], numbers > 0, [0]])))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= least
        if not keep.any():
            return
        starts, ends = starts[keep], ends[keep]
        lengths = ends - starts + 1  # each run with a separator after it
        total = np.cumsum(lengths)
        places = np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1])
        run = np.append(numbers, 0)[places]
        run[total - 1] = 0
        self.texts.append(run)
        self.places.append(places)
        self.docs.append(np.full(len(run), doc))
        self.held += len(run)

    def hits(self) -> list[tuple[int, list[tuple[int, int]], list]]:
        """For each document: words hit, merged spans of words, items with an occurrence."""
        out: list[tuple[int, list[tuple[int, int]], list]] = [(0, [], [])] * len(self.n_words)
        if not self.texts:
            return out
        index = FmIndex(np.concatenate(self.texts), len(self.phrases.vocabulary))
        low, high = index.search(self.phrases.table, self.phrases.lengths)
        counts = np.maximum(high - low, 0)
        if not counts.any():
            return out
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at = index.locate(rows)
        doc, start = np.concatenate(self.docs)[at], np.concatenate(self.places)[at]
        end = start + self.phrases.lengths[phrase]
        order = np.lexsort((start, doc))
        doc, start, end, phrase = doc[order], start[order], end[order], phrase[order]
        for a, b in zip(bounds := np.flatnonzero(np.diff(doc, prepend=-1)), [*bounds[1:], len(doc)], strict=True):
            reach = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate([[True], start[a + 1 : b] > reach[:-1]]))
            spans = list(zip(start[a:b][new].tolist(), reach[np.append(new[1:], b - a) - 1].tolist(), strict=True))
            items = {x for p in np.unique(phrase[a:b]).tolist() for x in self.phrases.items[p]}
            out[doc[a]] = (sum(e - s for s, e in spans), spans, list(items))
        return out


def _phrases(data: bytes) -> Phrases:
    return resident("phrases", data, lambda: pickle.loads(data))


HITS = "struct<n_words: long, n_hit: long, spans: array<struct<start: long, end: long>>, items: array<long>>"


def _search(docs: DataFrame, text_col: str, hits_col: str, phrases: Phrases) -> tuple[DataFrame, Broadcast]:
    """docs with hits of the phrases, and what was broadcast for that."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(phrases))

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        shard = Shard(_phrases(shared.value))
        rows: list[dict] = []

        def close() -> None:
            for n, (hit, spans, items) in zip(shard.n_words, shard.hits(), strict=True):
                rows.append({"n_words": n, "n_hit": hit, "spans": [{"start": a, "end": b} for a, b in spans], "items": items})
            shard.clear()

        for _, part in slices(texts):
            for text in part:
                shard.add(text)
                if shard.held >= SHARD_WORDS:
                    close()
        close()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.int64()))]))

    return docs.withColumn(hits_col, hits(F.col(text_col).cast("string"))), shared


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of about block_bytes of text; the driver holds one at a time."""
    rows, held = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        rows.append((r[0], r[1]))
        held += len((r[1] or "").encode())
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    hits_col: str = "hits",
    window: int = WINDOW,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """docs with a struct of n_words, n_hit, merged spans of words (start, end exclusive) and the items found, sorted.

    Items with a null id count as no item but their words are hit. A column named hits_col gives way to '_' before it.
    """
    bound_batches(docs.sparkSession)
    hits_col = free_name(docs.columns, hits_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block, more = next(blocks, []), next(blocks, None)
    sort = lambda df: df.withColumn(hits_col, F.col(hits_col).withField("items", F.array_sort(F.array_compact(F.col(hits_col)["items"]))))
    if more is None:
        return sort(_search(docs, text_col, hits_col, Phrases(block, window))[0])
    key = free_name([*docs.columns, hits_col], "row_key")
    rows = keyed(docs, id_col, key)
    merged = None
    for own in chain([block, more], blocks):
        hits, shared = _search(rows.select(key, text_col), text_col, hits_col, Phrases(own, window))
        hits = materialise(hits.drop(text_col), "hits")
        shared.destroy()
        merged = hits if merged is None else merged.unionByName(hits)
    merged = merged.groupBy(key).agg(F.max(f"{hits_col}.n_words").alias("n"), F.flatten(F.collect_list(f"{hits_col}.spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list(f"{hits_col}.items"))).alias("i"))
    spans = _merged(F.array_sort("s"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    merged = merged.select(key, F.struct(F.col("n").alias("n_words"), hit.alias("n_hit"), spans.alias("spans"), F.col("i").alias("items")).alias(hits_col))
    return sort(rows.join(merged, key).drop(key))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _merged(spans: pa.Array) -> pa.Array:
    """Sorted spans of each row, overlapping and touching ones as one."""
    out = []
    for row in spans.to_pylist():
        own: list[dict] = []
        for x in row or []:
            if own and x["start"] <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], x["end"])
            else:
                own.append(x)
        out.append(own)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def contaminated(hits):
    """A twentieth or more of the words is hit, and one at least."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, hits_col: str = "hits", text_col: str = "text", **options) -> DataFrame:
    """Text of docs without the words in merged spans, joined by blanks, for documents with spans; others as they are."""
    hits_col = free_name(docs.columns, hits_col)
    found = find(docs, benchmark, text_col=text_col, hits_col=hits_col, **options)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        from mnemos.llm.common import word_spans

        out = []
        for text, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            if text is not None and h["spans"]:
                places = word_spans(text)
                kept, at = [], 0
                for s in h["spans"]:
                    kept.append(text[at : places[s["start"]][0]])
                    at = places[s["end"] - 1][1]
                text = " ".join(x for x in map(str.strip, [*kept, text[at:]]) if x)
            out.append(text)
        return pa.array(out, pa.string())

    return found.withColumn(text_col, cut(text_col, hits_col))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = F.col("hits")
    return find(docs, benchmark).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits["items"].cast("array<string>")), ","), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )
