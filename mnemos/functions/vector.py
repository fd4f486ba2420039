"""Vectors: cosine, exact nearest neighbours, hashing embeddings, float32 packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemos.functions.text import WIDE_SEPARATORS, tokens
from mnemos.sources.scratch import kept

EMPTY_TOKEN = "__empty__"
PAIR_ROWS = 200_000
PAIR_BYTES = 64 << 20
#: Numbers of a block of vectors, of a tile of similarities, and what a matrix product may be off by.
BLOCK_NUMBERS, TILE_NUMBERS, NEARLY = 4 << 20, 4 << 20, 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if a vector has no length; vectors of different sizes are the caller's to keep apart."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def small(df: DataFrame, most: int = PAIR_ROWS) -> DataFrame:
    """df, to be broadcast if it is measured to be small (see rows_of); joins shuffle it otherwise."""
    return F.broadcast(df) if rows_of(df, most) <= most else df


def rows_of(df: DataFrame, most: int = PAIR_ROWS, most_bytes: int = PAIR_BYTES) -> int:
    """How many rows df has, or most + 1 if it has more, or more than most_bytes of text and array elements."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, T.StringType | T.BinaryType) else 8 * F.size(f.name) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType)]
    size = sum((F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long") for x in wide), F.lit(8 * len(df.columns)).cast("long"))
    held = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return held["n"] if held["size"] <= most_bytes else most + 1


def hinted(df: DataFrame, rows: int, most: int = PAIR_ROWS) -> DataFrame:
    """df, to be broadcast if it is known to have at most `rows` rows and those are few."""
    return F.broadcast(df) if rows <= most else df


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row what dot() gives, summed in its order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total = total + a[:, j] * b[:, j]
    return total


def _matrix(lists: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The lists of these rows, all of one size; elements that are null count as 0."""
    flat = lists.take(pa.array(rows)).combine_chunks().flatten()
    return pc.fill_null(pc.cast(flat, pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _sizes(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), -1).to_numpy()


def _best(q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of v, similarities) of the k nearest of each query; ties go to the smaller place.

    A matrix product tells which may be among them; those are computed anew, bit by bit as cosine() does.
    """
    qn, vn = np.sqrt(_dots(q, q)), np.sqrt(_dots(v, v))
    unit = lambda m, n: m / np.where(n == 0, 1.0, n)[:, None]
    units = unit(v, vn).T
    tile, step = max(1, TILE_NUMBERS // len(v)), max(1, TILE_NUMBERS // max(1, v.shape[1]))
    for at in range(0, len(q), tile):
        about = np.nan_to_num(unit(q[at : at + tile], qn[at : at + tile]) @ units, nan=np.inf)
        least = np.partition(about, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(about), -np.inf)
        a, b = np.nonzero(about >= least[:, None] - NEARLY)
        a, exact = a + at, []
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            size = qn[x] * vn[y]
            exact.append(np.where(size == 0, 0.0, _dots(q[x], v[y]) / np.where(size == 0, 1.0, size)))
        s = np.concatenate(exact) if exact else np.zeros(0)
        order = np.lexsort((place[b], np.where(np.isnan(s), -np.inf, -s), a))
        a, b, s = a[order], b[order], s[order]
        first = np.searchsorted(a, a, side="left")
        keep = np.arange(len(a)) - first < k
        yield a[keep], b[keep], s[keep]


def best_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, keys: Sequence[str], query_id: str, id_col: str) -> DataFrame:
    """query_id, id and similarity of the k nearest vectors (v) of each query (qv) in each block of vectors of its keys.

    A block holds BLOCK_NUMBERS numbers or so, of vectors as of queries; each pair of blocks of the same keys is a group, so
    what a task holds is bounded and the keys of many vectors are spread.
    """
    def blocks(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.greatest(F.size(column), F.lit(0)).cast("long")) / BLOCK_NUMBERS)).cast("int").alias(name))

    counts = small(kept(blocks(queries, "qv", "q_blocks").join(blocks(vectors, "v", "v_blocks"), list(keys))))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.select(query_id, *keys, "qv").join(counts, list(keys)).withColumn("q_block", dealt(query_id, "q_blocks")).withColumn("v_block", every("v_blocks")).drop("q_blocks", "v_blocks")
    v = vectors.select(id_col, *keys, "v").join(counts, list(keys)).withColumn("v_block", dealt(id_col, "v_blocks")).withColumn("q_block", every("q_blocks")).drop("q_blocks", "v_blocks")
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({query_id: left[query_id].slice(0, 0), id_col: right[id_col].slice(0, 0), "similarity": pa.array([], pa.float64())})]
        q_sizes, v_sizes = _sizes(left["qv"]), _sizes(right["v"])
        place = np.empty(right.num_rows, np.int64)
        place[pc.sort_indices(right[id_col]).to_numpy()] = np.arange(right.num_rows)
        for dim in np.intersect1d(q_sizes[q_sizes >= 0], v_sizes[v_sizes >= 0]):
            mine, theirs = np.flatnonzero(q_sizes == dim), np.flatnonzero(v_sizes == dim)
            for a, b, s in _best(_matrix(left["qv"], mine, dim), _matrix(right["v"], theirs, dim), place[theirs], k):
                out.append(pa.table({query_id: left[query_id].take(pa.array(mine[a])), id_col: right[id_col].take(pa.array(theirs[b])), "similarity": pa.array(s)}))
        return pa.concat_tables(out)

    group = [*keys, "q_block", "v_block"]
    v = v.select(*[F.col(c).alias(c) for c in v.columns])  # both sides may come from one table
    return q.groupBy(*group).cogroup(v.groupBy(*group)).applyInArrow(meet, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: Column | int, on: Sequence[str] = ("user_id",), query_id: str = "query_id", id_col: str = "memory_id", rows: int | None = None) -> DataFrame:
    """query_id, id, similarity and rank of the k nearest vectors (ties: smaller id) of each query among those of its user.

    queries: query_id, keys, vector; vectors: id, keys, vector. Only vectors of equal size are compared. For a number k blocks
    of queries and vectors meet (best_in_blocks); for a column pairs do, with norms computed once a row, and rank and cut happen
    within a map task before the shuffle (window group limit). rows: a bound on the queries' number, if known; they are
    counted otherwise.
    """
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), id_col)
    if isinstance(k, int):
        scored = best_in_blocks(queries.select(query_id, *on, F.col("vector").alias("qv")), vectors.select(id_col, *on, F.col("vector").alias("v")), k, on, query_id, id_col)
    else:
        q = queries.select(query_id, *on, F.col("vector").alias("qv"), norm(F.col("vector")).alias("qn"))
        v = vectors.select(id_col, *on, F.col("vector").alias("v"), norm(F.col("vector")).alias("vn"))
        pairs = v.join(small(q) if rows is None else hinted(q, rows), list(on)).where(F.size("qv") == F.size("v"))
        scored = pairs.select(query_id, id_col, cosine(F.col("qv"), F.col("v"), F.col("qn"), F.col("vn")).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hashed_tokens(text: Column) -> Column:
    """Tokens that the hashing embedding counts; a text without any has one of its own."""
    found = tokens(text, 1, WIDE_SEPARATORS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(EMPTY_TOKEN)))


def _blake_buckets(tokens: DataFrame, dim: int) -> DataFrame:
    """token, idx and sign by BLAKE2b of 8 bytes; Python sees each distinct token once."""
    @F.arrow_udf("struct<idx: int, sign: int>")
    def bucket(words: pa.Array) -> pa.Array:
        from hashlib import blake2b

        digests = [blake2b(w.encode(), digest_size=8).digest() for w in words.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([int.from_bytes(d[:4], "little") % dim for d in digests], pa.int32()), pa.array([1 if d[4] % 2 == 0 else -1 for d in digests], pa.int32())], ["idx", "sign"]
        )

    return tokens.withColumn("b", bucket("token")).select("token", "b.idx", "b.sign")


def md5_bucket(token: Column, dim: int) -> tuple[Column, Column]:
    """The same out of MD5: the first 8 hex digits modulo dim, the sign of the ninth's parity."""
    digest = F.md5(token.cast("binary"))
    number = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
    return (number(1, 8) % dim).cast("int"), F.when(number(9, 1) % 2 == 0, 1).otherwise(-1)


def hash_buckets(texts: DataFrame, id_col: str, text_col: str, dim: int, hashing: str = "blake2b") -> DataFrame:
    """id, idx and summed value of every text: signed 1 + ln(1 + count) of its tokens, not normalised."""
    if dim < 8:
        raise ValueError("dim has to be 8 at least")
    counts = texts.select(id_col, F.explode(hashed_tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    if hashing == "blake2b":
        known = _blake_buckets(counts.select("token").distinct(), dim)
        placed = counts.join(known, "token")
    else:
        idx, sign = md5_bucket(F.col("token"), dim)
        placed = counts.select("*", idx.alias("idx"), sign.alias("sign"))
    return placed.groupBy(id_col, "idx").agg(F.sum(F.col("sign") * (1 + F.log(1.0 + F.col("n")))).alias("value"))


def hash_embed(texts: DataFrame, id_col: str, text_col: str, dim: int, hashing: str = "blake2b") -> DataFrame:
    """id and vector (array<float>, length 1 unless all sums cancel) of every text."""
    values = hash_buckets(texts, id_col, text_col, dim, hashing).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    sized = values.select(id_col, dense.alias("d")).withColumn("n", norm(F.col("d")))
    return sized.select(id_col, F.transform("d", lambda x: (x / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))).cast("float")).alias("vector"))


def packed(vector: Column) -> Column:
    """A vector as little-endian float32 bytes."""
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes() for v in vectors], pa.binary())

    return pack(vector.cast("array<float>"))


def unpacked(data: Column) -> Column:
    @F.arrow_udf("array<float>")
    def unpack(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, "<f4").tolist() for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return unpack(data)
