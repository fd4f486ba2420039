"""Token ids in binary files of patched frame-of-reference blocks.

Documents are encoded with a `tokenizers` vocabulary, an end id is appended to each, and the ids are written in
ascending order of document id. A file is a run of segments with line feeds between them; a segment holds whole
documents (one at least, so a very long text makes one long segment) and reads:

    header    magic 'PFR1', bytes of the segment (u32), partition (u32), sequence number in it (u32), ids before it
              in its partition (u64), ids (u64), documents (u32), blocks (u32), ids a block (u32)
    documents their ids (i64 each), their id counts (u64 each), whether their id is null (u8 each)
    index     byte offsets of the blocks after the index (u64 each), with the end as the last
    blocks    minimum (u32), width (u8), 0 (u8), exceptions (u16), the low `width` bits of every id less the minimum,
              packed from the lowest bit on in 32-bit words, then the exceptions' places (u16 each) and differences
              (u32 each)

All numbers are little-endian. A block's width is that of its differences' percentile (90 by default), so a few large
ids cost an exception each and not a wider block; the last block is filled up with its own last id. Files are written
by Spark's text writer, which puts out the bytes as they are: any Hadoop file system will do, and the commit protocol
keeps files of lost or repeated attempts out.

Null texts count as empty and have the end id only; null document ids come first; repeated rows stay, next to each
other. An empty table gives no segment.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemos.llm.common import SLICE_BYTES, bound_batches, materialise, resident, scratch_path, vocabulary_bytes
from mnemos.llm.pretokens import ChunkEncoder, byte_mapped, gather, strings, table_of, text_slices

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQQIII")
GROUP = 32


# --- blocks -----------------------------------------------------------------------------------------------------


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2^width, a multiple of 32 each, as rows of packed bytes."""
    lanes = values.reshape(-1, GROUP).astype(np.uint64)
    out = np.zeros((len(lanes), width + 1), np.uint64)
    for i in range(GROUP):
        word, shift = divmod(i * width, 32)
        moved = lanes[:, i] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return np.ascontiguousarray(out[:, :width].astype("<u4")).reshape(len(values), -1).view(np.uint8)


def _unpack(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), size), np.uint32)
    words = np.ascontiguousarray(packed).view("<u4").reshape(-1, width).astype(np.uint64)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    out, mask = np.empty((len(words), GROUP), np.uint32), np.uint64((1 << width) - 1)
    for i in range(GROUP):
        word, shift = divmod(i * width, 32)
        out[:, i] = ((words[:, word] | words[:, word + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    return out.reshape(len(packed), size)


def pack_blocks(ids: np.ndarray, size: int = 128, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """(offsets of the blocks and the end, the blocks) of unsigned 32-bit ids; size is a multiple of 32 below 65536."""
    count = -(-len(ids) // size)
    if not count:
        return np.zeros(1, np.int64), b""
    rows = np.concatenate([ids, np.full(count * size - len(ids), ids[-1])]).astype(np.uint32).reshape(count, size)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    at = min(size - 1, max(0, int(np.ceil(percentile * size)) - 1))
    width = _widths(np.partition(diff, at, axis=1)[:, at])
    odd = diff >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    odd[width > 31] = False
    exceptions = odd.sum(axis=1)
    packed_len = size // 8 * width
    ends = np.cumsum(8 + packed_len + 6 * exceptions)
    starts = ends - (8 + packed_len + 6 * exceptions)
    out = np.zeros(ends[-1], np.uint8)
    head = np.zeros((count, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 6:] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[starts[:, None] + np.arange(8)] = head
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        kept = diff[own] & np.uint32((1 << int(w)) - 1)
        out[(starts[own] + 8)[:, None] + np.arange(size // 8 * w)] = _pack(kept, int(w))
    block, place = np.nonzero(odd)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (starts + 8 + packed_len)[block]
    out[(tail + 2 * rank)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(tail + 2 * exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.concatenate([[0], ends]), out.tobytes()


def unpack_blocks(offsets: np.ndarray, data: np.ndarray, size: int) -> np.ndarray:
    """The ids of whole blocks whose offsets (and end) are given; any run of an index' offsets will do."""
    starts = offsets[:-1].astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(starts), size), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        out[own] = _unpack(data[(starts[own] + 8)[:, None] + np.arange(size // 8 * w)], int(w), size)
    block = np.repeat(np.arange(len(starts)), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (starts + 8 + size // 8 * width)[block]
    if len(block):
        place = np.ascontiguousarray(data[(tail + 2 * rank)[:, None] + np.arange(2)]).view("<u2")[:, 0]
        out[block, place] = np.ascontiguousarray(data[(tail + 2 * exceptions[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (out + low[:, None]).ravel()


# --- segments ---------------------------------------------------------------------------------------------------


def write_segment(doc_ids: list, encoded: list[bytes], part: int, seq: int, before: int, size: int, percentile: float) -> bytes:
    """One segment of documents whose ids are given as little-endian 32-bit integers."""
    ids = np.frombuffer(b"".join(encoded), "<u4")
    offsets, blocks = pack_blocks(ids, size, percentile)
    null = np.array([x is None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    counts = np.array([len(x) // 4 for x in encoded], "<u8")
    body = b"".join([numbers.tobytes(), counts.tobytes(), null.tobytes(), offsets.astype("<u8").tobytes(), blocks])
    return HEAD.pack(MAGIC, HEAD.size + len(body), part, seq, before, len(ids), len(doc_ids), len(offsets) - 1, size) + body


def read_segments(data: bytes) -> Iterator[dict]:
    """part, seq, before, doc_ids, counts and ids of each segment of a file."""
    at = 0
    while at < len(data):
        if data[at] == 10:
            at += 1
            continue
        magic, length, part, seq, before, n_ids, n_docs, n_blocks, size = HEAD.unpack_from(data, at)
        if magic != MAGIC or at + length > len(data):
            raise ValueError(f"no whole segment at byte {at}")
        pos = at + HEAD.size
        numbers = np.frombuffer(data, "<i8", n_docs, pos)
        counts = np.frombuffer(data, "<u8", n_docs, pos + 8 * n_docs).astype(np.int64)
        null = np.frombuffer(data, np.uint8, n_docs, pos + 16 * n_docs)
        pos += 17 * n_docs
        offsets = np.frombuffer(data, "<u8", n_blocks + 1, pos)
        pos += 8 * (n_blocks + 1)
        ids = unpack_blocks(offsets, np.frombuffer(data, np.uint8, int(offsets[-1]), pos), size)[:n_ids]
        yield {"part": part, "seq": seq, "before": before, "doc_ids": [None if z else int(x) for x, z in zip(numbers, null, strict=True)], "counts": counts, "ids": ids}
        at += length + 1


# --- encoding ---------------------------------------------------------------------------------------------------


class LibraryEncoder(ChunkEncoder):
    """Ids of the tokenizers library.

    Where the vocabulary first splits texts by the public pattern and has no normaliser, the library's model gets each
    distinct pre-token once. A text with one of the vocabulary's added tokens, or with a character at which the library
    splits in another way than the pattern does (newer ones that it doesn't know), goes to the library whole, as do all
    texts of other vocabularies (`odd` is then None).
    """

    def __init__(self, vocabulary: bytes, odd: str | None):
        import tokenizers

        super().__init__(public_tokenizers.PATTERN)
        self.library = tokenizers.Tokenizer.from_buffer(vocabulary)
        self.library.no_padding()
        self.library.no_truncation()
        self.odd = odd

    def encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        tokenize = self.library.model.tokenize
        return [array("i", [x.id for x in tokenize(byte_mapped(p))]).tobytes() for p in pretokens]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.ones(len(texts), bool) if self.odd is None else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return super().encode(texts)
        ids, bounds = super().encode(texts.filter(pa.array(~odd)))
        whole = self.library.encode_batch_fast(strings(texts.filter(pa.array(odd))), add_special_tokens=False)
        more, starts, sizes = table_of([array("i", x.ids).tobytes() for x in whole])
        first, lengths = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        first[~odd], lengths[~odd] = bounds[:-1], np.diff(bounds)
        first[odd], lengths[odd] = len(ids) + starts, sizes
        return gather(np.concatenate([ids, more]), first, lengths), np.concatenate([[0], np.cumsum(lengths)])


def _strange(split_alike, least: int = 16, top: int = 1 << 16) -> str:
    """A class of the characters up to `top` (in runs of `least`) at which two splitters disagree, and all beyond."""
    ranges: list[tuple[int, int]] = []

    def hunt(start: int, size: int) -> None:
        own = [chr(c) for c in range(start, start + size) if c and not 0xD800 <= c < 0xE000]
        if own and not split_alike("".join(f"a{c}b {c}1{c} " for c in own)):
            if size > least:
                for at in range(start, start + size, size // 4):
                    hunt(at, size // 4)
            else:
                ranges.append((start, start + size - 1))

    for at in range(0, top, 1024):
        hunt(at, 1024)
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in [*ranges, (top, 0x10FFFF)]) + "]"


def encoder_options(vocabulary: bytes) -> tuple[bytes, str | None]:
    """What LibraryEncoder takes, found out on the driver from a vocabulary file; the splitters are compared by probes."""
    import regex
    import tokenizers

    spec = json.loads(vocabulary)
    splitter = spec.get("pre_tokenizer") or {}
    if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or spec.get("normalizer"):
        return vocabulary, None
    own, theirs = regex.compile(public_tokenizers.PATTERN).findall, tokenizers.Tokenizer.from_buffer(vocabulary).pre_tokenizer.pre_tokenize_str
    strange = _strange(lambda probe: [x for x, _ in theirs(probe)] == list(map(byte_mapped, own(probe))))
    return vocabulary, "|".join([strange, *(regex.escape(x["content"], special_only=True) for x in spec.get("added_tokens", []))])


def library_encoder(vocabulary: bytes, odd: str | None) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident("library", (vocabulary, odd), lambda: LibraryEncoder(vocabulary, odd))


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    block_ids: int = 128,
    percentile: float = 0.9,
    segment_ids: int = 1 << 18,
    segment_docs: int = 1 << 14,
    file_segments: int = 16,
    segment_bytes: int = 8 << 20,
) -> None:
    """Encode docs and write their ids to files under `path`, in ascending order of the integer column id_col.

    Rows are dealt by ranges of (id, hash of the text): one shuffle of the texts, whose ties are split too. A task
    holds one segment's ids at a time. Sizes: segments close at segment_ids ids or segment_docs documents; a file has
    file_segments lines. A segment of over segment_bytes (a very long text) is followed by an empty line for each
    segment_bytes of its own, so files have file_segments times that and one segment at most.
    """
    spark = docs.sparkSession
    bound_batches(spark, SLICE_BYTES)
    shared = spark.sparkContext.broadcast(encoder_options(vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))))
    end = int(end_id).to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = library_encoder(*shared.value), TaskContext.get().partitionId()
        doc_ids: list = []
        encoded: list[bytes] = []
        seq = before = held = 0

        def image() -> pa.RecordBatch:
            data = write_segment(doc_ids, encoded, part, seq, before, block_ids, percentile)
            return pa.RecordBatch.from_arrays([pa.array([data, *[b""] * (len(data) // segment_bytes)], pa.binary())], ["image"])

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1), SLICE_BYTES):
                ids, bounds = own.encode(texts)
                for a, b in pairwise(bounds.tolist()):
                    doc_ids.append(next(names))
                    encoded.append(ids[a:b].tobytes() + end)
                    held += b - a + 1
                    if held >= segment_ids or len(doc_ids) >= segment_docs:
                        yield image()
                        seq, before, held, doc_ids, encoded = seq + 1, before + held, 0, [], []
        if doc_ids:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    images = dealt.mapInArrow(segments, "image binary")
    images.select(F.col("image").cast("string")).write.option("maxRecordsPerFile", file_segments).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """part, before (ids of the partition before the document), doc_id, n_tokens, ids_le (32-bit little-endian)."""
    bound_batches(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in read_segments(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(s["counts"])
                    raw = s["ids"].astype("<u4").tobytes()
                    starts = ends - s["counts"]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([s["part"]] * len(ends), pa.int64()),
                            "before": pa.array(starts + s["before"], pa.int64()),
                            "doc_id": pa.array(s["doc_ids"], pa.int64()),
                            "n_tokens": pa.array(s["counts"], pa.int64()),
                            "ids_le": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        }
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(documents, "part long, before long, doc_id long, n_tokens long, ids_le binary")


def with_starts(docs: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before; one small row a partition is summed up and joined back."""
    totals = docs.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("before"))


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """documents written to token files and read back: places, counts and checksums of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path)
    read = read_token_files(spark, path).select("part", "before", "doc_id", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
    return with_starts(materialise(read, "token-documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
