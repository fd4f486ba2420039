"""Byte-level BPE, token files and token counts against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemos.llm import byte_bpe, token_counts, token_files

RANKS = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
VOCABULARY = open(P.path("byte_bpe_50k.json"), "rb").read()
LIBRARY = tokenizers.Tokenizer.from_buffer(VOCABULARY)
PIECES = ["a", "The", " ", "  ", "\n", " \n", "\t", "é", "ß", "漢字", "12", "½", "'s", "!", "...", "　", "\x85", "\x1c", "😀", "_", "\r\n", "​", "-", "<|endoftext|>"]
TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), max_size=20)


def split(encoded):
    ids, bounds = encoded
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_libraries(texts):
    array = pa.array(texts, pa.large_string())
    codec = byte_bpe.codec(RANKS, P.PATTERN)
    assert split(codec.encode(array)) == [TIKTOKEN.encode_ordinary(x) for x in texts]
    assert [codec.decode(x) for x in split(codec.encode(array))] == [x.encode() for x in texts]
    assert split(token_files.library_encoder(*token_files.encoder_options(VOCABULARY)).encode(array)) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_pretokens_and_a_full_cache(monkeypatch):
    from mnemos.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE_ENTRIES", 10)
    codec = byte_bpe.SentencepieceBpe(RANKS, P.PATTERN)
    texts = ["x" * 5000, "abc " * 300, "".join(chr(0x4E00 + i) for i in range(800))]
    for _ in range(3):
        assert split(codec.encode(pa.array(texts, pa.large_string()))) == [TIKTOKEN.encode_ordinary(x) for x in texts]


def test_encode_and_decode_keep_rows_and_columns(spark, odd, empty):
    clashing = odd.withColumnRenamed("lang", "ids")
    out = byte_bpe.decode(byte_bpe.encode(clashing), "_ids")
    both = byte_bpe.round_trip(clashing)
    assert sorted(map(str, both.collect())) == sorted(map(str, out.collect())) and both.columns == out.columns
    assert out.columns == [*clashing.columns, "_ids", "decoded"]
    for r in out.collect():
        assert r["_ids"] == TIKTOKEN.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


def test_op10(spark, sf_dir, odd_rows, empty_dir):
    got = sorted(map(tuple, byte_bpe.op10_byte_bpe(spark, sf_dir).collect()), key=str)
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = TIKTOKEN.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.op10_byte_bpe(spark, empty_dir).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([32, 128]), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, size, percentile):
    array = np.array(ids, np.uint32)
    offsets, data = token_files.pack_blocks(array, size, percentile)
    assert token_files.unpack_blocks(offsets, np.frombuffer(data, np.uint8), size)[: len(ids)].tolist() == ids
    for i in range(len(offsets) - 1):  # any block alone, by its index entry
        part = token_files.unpack_blocks(offsets[i : i + 2], np.frombuffer(data, np.uint8), size)
        assert part[: len(ids) - i * size].tolist() == ids[i * size : (i + 1) * size]


def test_outliers_are_exceptions():
    ids = np.array([5] * 127 + [4_000_000_000], np.uint32)
    offsets, data = token_files.pack_blocks(ids, 128, 0.9)
    assert offsets[-1] == 8 + 6  # width 0 and one exception


def test_segments_round_trip_and_damage_is_told():
    encoded = [np.arange(n, dtype="<i4").tobytes() for n in (3, 0, 300)]
    image = token_files.write_segment([7, None, -9], encoded, 2, 5, 11, 128, 0.9)
    (s,) = token_files.read_segments(image + b"\n")
    assert (s["part"], s["seq"], s["before"], s["doc_ids"], s["counts"].tolist()) == (2, 5, 11, [7, None, -9], [3, 0, 300])
    assert s["ids"].tolist() == [*range(3), *range(300)]
    for bad in (image[:-1], b"X" + image[1:]):
        try:
            list(token_files.read_segments(bad))
        except ValueError:
            continue
        raise AssertionError


def test_op4(spark, sf_dir, odd_rows, empty_dir):
    got = sorted(map(tuple, token_files.op4_token_files(spark, sf_dir).collect()), key=lambda r: r[1])
    want = {}
    for doc_id, text, *_ in odd_rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, last = 0, None
    for doc_id, start, n, crc in got:
        assert start == at and (last is None or doc_id is not None and last <= doc_id)
        want[doc_id].remove((n, crc))
        at, last = at + n, doc_id
    assert not any(want.values())
    assert token_files.op4_token_files(spark, empty_dir).count() == 0


def test_many_segments_and_files(spark, clean, tmp_path):
    token_files.write_token_files(clean, str(tmp_path / "t"), segment_ids=200, file_segments=2)
    got = token_files.with_starts(token_files.read_token_files(spark, str(tmp_path / "t"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(40))
    ids = np.concatenate([np.frombuffer(bytes(r["ids_le"]), "<u4") for r in got])
    texts = [r["text"] for r in clean.orderBy("doc_id").collect()]
    assert ids.tolist() == [i for x in texts for i in [*LIBRARY.encode(x, add_special_tokens=False).ids, 0]]


def test_odd_characters_and_long_texts(spark, tmp_path):
    """Characters that splitters treat differently, added tokens, contractions, lines; files get filler lines after long texts."""
    texts = ["a\u0558't b", "x<|endoftext|> y", "it's\nWe'll  don't", "foo.\nBar, baz!", "\ua7cea 1\u2081", "日本 語\u3000x", "\U0001f600 a\U00010400b", " lead", "trail ", "", "w" * 5000 + " z" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    token_files.write_token_files(docs, str(tmp_path / "t"), segment_ids=50, segment_docs=2, file_segments=3, segment_bytes=200)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [np.frombuffer(bytes(r["ids_le"]), "<u4").tolist() for r in got] == [[*LIBRARY.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert any(b"\n\n" in b or b[:1] == b"\n" for b in (f.read_bytes() for f in (tmp_path / "t").glob("part-*")))


def test_rollup_is_idempotent_and_additive(spark, clean, tmp_path):
    counts = token_counts.count_tokens(clean).withColumnRenamed("n_chars", "x").selectExpr("source", "lang", "'v1' AS tokenizer", "n_tokens")
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("a", token_counts.inserts(counts)) and not r.commit("a", token_counts.inserts(counts))
    want = {}
    for row in clean.collect():
        k = (row["source"], row["lang"], "v1")
        n, t = want.get(k, (0, 0))
        want[k] = (n + 1, t + len(TIKTOKEN.encode_ordinary(row["text"])))
    read = lambda: {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}
    assert read() == want
    assert r.compact() == 1 and read() == want and [x["batch"] for x in r.committed().collect()] == ["a"]
    assert not r.commit("a", token_counts.inserts(counts))
    gone = counts.where("source = 's0'")
    r.commit("b", token_counts.deletes(gone))
    assert read() == {k: v for k, v in want.items() if k[0] != "s0"}
    left = counts.where("source = 's1'")
    r.commit("c", token_counts.revisions(left, left.selectExpr("source", "lang", "'v2' AS tokenizer", "n_tokens + 1 AS n_tokens")))
    assert read() == {(s, lang, "v2"): (n, t + n) for (s, lang, _), (n, t) in want.items() if s == "s1"}
    assert r.compact() == 2 and read() == {(s, lang, "v2"): (n, t + n) for (s, lang, _), (n, t) in want.items() if s == "s1"}


def test_a_failed_attempt_is_overwritten(spark, clean, tmp_path):
    counts = token_counts.count_tokens(clean).selectExpr("source", "lang", "'v1' AS tokenizer", "n_tokens")
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    spark.createDataFrame([("x", "y", "z", 9, 9)], token_counts.TOTALS).write.parquet(f"{tmp_path}/r/batches/a")
    (tmp_path / "r/batches/a/_SUCCESS").unlink()
    assert r.totals().count() == 0
    assert r.commit("a", token_counts.inserts(counts))
    assert sum(x["n_docs"] for x in r.totals().collect()) == 40


def test_a_clashing_count_column_stays(spark, clean):
    out = token_counts.count_tokens(clean.limit(2).withColumn("n_tokens", F.lit("mine"))).collect()
    assert all(r["n_tokens"] == "mine" and r["_n_tokens"] == len(TIKTOKEN.encode_ordinary(r["text"])) for r in out)


def test_op9(spark, sf_dir, odd_rows, empty_dir):
    labels = {1: (1, 0), 2: (0, 1), 3: (1, 1)}
    want = {}

    def add(key, sign, n):
        a, b = want.get(key, (0, 0))
        want[key] = (a + sign, b + sign * n)

    for doc_id, text, lang, source, _ in odd_rows:
        n = len(TIKTOKEN.encode_ordinary(text or ""))
        quality, toxic = labels.get(doc_id, (0, 0))
        add((source, lang, "byte_bpe_50k"), 1, n)
        if toxic or quality:
            add((source, lang, "byte_bpe_50k"), -1, n)
        if quality and not toxic:
            add((source, lang, "byte_bpe_50k-end"), 1, n + 1)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.op9_token_counts(spark, sf_dir).collect()}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}
    assert token_counts.op9_token_counts(spark, empty_dir).count() == 0
