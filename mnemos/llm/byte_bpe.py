"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

A rank file (base64 of a token's bytes, its rank) becomes a sentencepiece BPE model: the bytes of each token are
mapped to one printable character each, the piece's score is its negative rank, and the normaliser is the identity
without added or removed white space. Sentencepiece then merges the pair with the best score first, leftmost among
equals, as rank-based BPE does. Texts are split by the vocabulary's pre-token pattern and each pre-token is encoded
on its own; ids are ranks. Decoding maps each id to its piece and the piece's characters back to bytes.

Nulls and empty texts give an empty id list. Very long texts and pre-tokens are encoded whole. Lone surrogates,
which Spark strings can't hold, aren't met.
"""

from __future__ import annotations

import base64
from array import array
from itertools import pairwise

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.common import bound_batches, free_name, resident, vocabulary_bytes
from mnemos.llm.pretokens import ChunkEncoder, byte_characters, byte_mapped, id_lists, text_slices


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank; ranks have to run from 0 without gaps."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps or repeat")
    return [token for _, token in pairs]


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the tokens' ranks; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(tokens) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class SentencepieceBpe(ChunkEncoder):
    def __init__(self, ranks: bytes, pattern: str):
        import sentencepiece

        super().__init__(pattern)
        self.tokens = parse_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(self.tokens))
        back = {c: b for b, c in enumerate(byte_characters())}
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]

    def encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.model.encode(list(map(byte_mapped, pretokens)), num_threads=1)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def codec(ranks: bytes, pattern: str) -> SentencepieceBpe:
    """One codec a worker and vocabulary."""
    return resident("codec", (ranks, pattern), lambda: SentencepieceBpe(ranks, pattern))


def encode(
    docs: DataFrame,
    text_col: str = "text",
    ids_col: str = "ids",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """docs with a column of token ids (array<int>, never null); a column of that name gives way to one with '_' before.

    vocabulary: path of a rank file on the driver, from where its bytes (at most 64 MB) go to the executors.
    Rows are encoded where they are, without a shuffle; a lost executor's rows are encoded again.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = codec(ranks.value, pattern)
        return id_lists([own.encode(part) for part in text_slices(texts)])

    return docs.withColumn(free_name(docs.columns, ids_col), ids(F.col(text_col).cast("string")))


def decode(
    docs: DataFrame,
    ids_col: str = "ids",
    bytes_col: str = "decoded",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """docs with a binary column of what the ids stand for; null ids give empty bytes, an id out of range fails."""
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        own = codec(ranks.value, pattern)
        return pa.array([own.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids], pa.binary())

    return docs.withColumn(free_name(docs.columns, bytes_col), decoded(ids_col))


def round_trip(
    docs: DataFrame,
    text_col: str = "text",
    ids_col: str = "ids",
    bytes_col: str = "decoded",
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """docs encoded and decoded again, as encode() and decode() do, in one Python worker a task instead of two."""
    spark = docs.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        own, encoded, decoded = codec(ranks.value, pattern), [], []
        for part in text_slices(texts, 2 << 20):
            ids, bounds = own.encode(part)
            encoded.append((ids, bounds))
            decoded += [own.decode(ids[a:b].tolist()) for a, b in pairwise(bounds.tolist())]
        return pa.StructArray.from_arrays([id_lists(encoded), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    made = free_name(docs.columns, "made")
    out = docs.withColumn(made, both(F.col(text_col).cast("string")))
    ids_name, bytes_name = free_name(docs.columns, ids_col), free_name(docs.columns, bytes_col)
    return out.withColumn(ids_name, F.col(made)["ids"]).withColumn(bytes_name, F.col(made)["decoded"]).drop(made)


def digests(docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> list:
    """The digest columns of encoded and decoded documents."""
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids_col).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(bytes_col, 256).alias("decoded_sha256"),
    ]


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """documents encoded and decoded again: digests of ids and of the decoded bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs)
    return out.select("doc_id", *digests(out))
