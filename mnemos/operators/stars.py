"""Greedy star clusters of each user's rows, in the order of places, without a user's rows in one task.

A row that no star has taken gathers all free later rows that are near by cosine or by words; stars that are too small are
dropped and leave their rows free. Users of at most `block` rows are clustered by one task each, a bounded group. Larger ones
are cut into blocks of places and served in rounds, for all users at once: the first `heads` free rows of each user that were no
heads yet meet the user's blocks, which gives each row the heads it is near; from those, stars are picked one after the other.
A user is done with max_clusters stars. One whose round gave no star, so that stars are rare, has its remaining rows thinned
out: every pair of blocks is one group, in which near later rows are counted, and only rows that can ever lead a star are heads
from then on. Rounds take more heads each time, a block of them at most. The result is that of the loop, whatever the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.config import DEFAULT, EngineConfig
from mnemos.functions.vector import small
from mnemos.sources.scratch import kept

BLOCK, HEADS, TILE = 4_096, 128, 256


@dataclass
class Near:
    """Which rows are near which, by cosine or by the overlap of their words."""

    similar: float
    common: float

    def later(self, left: Side, right: Side) -> Iterator[tuple[int, np.ndarray]]:
        """(row of left, whether each row of right is near and later)."""
        holders = right.holders()
        for at in range(0, len(left.place), TILE):
            cosines = left.matrix[at : at + TILE] @ right.matrix.T if left.matrix.shape[1] == right.matrix.shape[1] else np.zeros((TILE, len(right.place)))
            for k, row in enumerate(cosines[: len(left.place) - at]):
                yield at + k, self.row(left, at + k, right, row, holders)

    def row(self, left: Side, i: int, right: Side, cosines: np.ndarray, holders: dict[str, np.ndarray]) -> np.ndarray:
        near = cosines >= self.similar if left.long[i] else np.zeros(len(right.place), bool)
        both = np.zeros(len(right.place))
        for w in left.words[i]:
            if w in holders:
                both[holders[w]] += 1
        either = right.counts + left.counts[i] - both
        near |= (both > 0) & (both / np.maximum(either, 1) >= self.common)
        return near & (right.place > left.place[i])


class Side:
    """Rows as a matrix of vectors of length 1 (or 0) and sets of words."""

    def __init__(self, pdf: pd.DataFrame):
        self.place = pdf["place"].to_numpy(np.int64)
        dim = max((len(v) for v in pdf["vector"] if v is not None), default=0)
        matrix = np.array([v if v is not None else np.zeros(dim) for v in pdf["vector"]], np.float64).reshape(len(pdf), dim)
        length = np.linalg.norm(matrix, axis=1)
        self.long = length > 0
        self.matrix = matrix / np.where(self.long, length, 1)[:, None]
        self.words = [set(w) for w in pdf["words"]]
        self.counts = np.array([len(w) for w in self.words])

    def holders(self) -> dict[str, np.ndarray]:
        out: dict[str, list[int]] = {}
        for i, own in enumerate(self.words):
            for w in own:
                out.setdefault(w, []).append(i)
        return {w: np.array(rows) for w, rows in out.items()}


def _of(pdf: pd.DataFrame, **columns: np.ndarray) -> pd.DataFrame:
    """Columns of one user's rows."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({"user_id": pd.Series([pdf["user_id"].iloc[0]] * n, dtype=object), **columns})


def _whole(narrow: DataFrame, near: Near, least: int, most: int) -> DataFrame:
    """Users of few rows: user_id, place and the place of the star's first row."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = Side(pdf)
        holders, free, star, made = own.holders(), np.ones(len(pdf), bool), np.full(len(pdf), -1), 0
        for i in range(len(pdf)):
            if not free[i] or made >= most:
                continue
            taken = near.row(own, i, own, own.matrix @ own.matrix[i], holders) & free
            if taken.sum() + 1 >= least:
                taken[i] = True
                free &= ~taken
                star[taken] = own.place[i]
                made += 1
        return _of(pdf, place=own.place[star >= 0], cluster=star[star >= 0])

    return narrow.groupBy("user_id").applyInPandas(gather, f"user_id {narrow.schema['user_id'].dataType.simpleString()}, place long, cluster long")


def _leaders(rows: DataFrame, near: Near, least: int) -> DataFrame:
    """(user_id, place) of rows with enough near later ones, taken or not; every pair of a user's blocks is a group."""
    first = F.transform(F.sequence("part", "parts"), lambda b: F.struct(F.col("part").alias("a"), b.alias("b"), F.lit(True).alias("left")))
    second = F.when(F.col("part") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("part") - 1), lambda a: F.struct(a.alias("a"), F.col("part").alias("b"), F.lit(False).alias("left")))).otherwise(F.array())
    cells = rows.select("user_id", "place", "vector", "words", F.inline(F.concat(first, second)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        left = Side(pdf[pdf["left"]])
        right = left if pdf["a"].iloc[0] == pdf["b"].iloc[0] else Side(pdf[~pdf["left"]])
        n = np.array([ok.sum() for _, ok in near.later(left, right)], np.int64)
        return _of(pdf, place=left.place[n > 0], n=n[n > 0])

    counts = cells.groupBy("user_id", "a", "b").applyInPandas(count, f"user_id {rows.schema['user_id'].dataType.simpleString()}, place long, n long")
    return counts.groupBy("user_id", "place").agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= least).select("user_id", "place")


def _met(rows: DataFrame, heads: DataFrame, near: Near) -> DataFrame:
    """(user_id, place, heads): rows that are near earlier heads, and which. Both have vector, words, part and parts."""
    left = heads.withColumn("part", F.explode(F.sequence("part", "parts"))).select("user_id", "part", "place", "vector", "words", F.lit(True).alias("left"))
    both = left.unionByName(rows.select("user_id", "part", "place", "vector", "words", F.lit(False).alias("left")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(a) or not len(b):
            return _of(pdf, place=np.zeros(0, np.int64), heads=np.zeros(0, object))
        left, right = Side(a), Side(b)
        close = np.zeros((len(b), len(a)), bool)
        for i, ok in near.later(left, right):
            close[:, i] = ok
        hit = np.flatnonzero(close.any(axis=1))
        return _of(pdf, place=right.place[hit], heads=pd.Series([left.place[close[j]] for j in hit], dtype=object))

    return both.groupBy("user_id", "part").applyInPandas(meet, f"user_id {rows.schema['user_id'].dataType.simpleString()}, place long, heads array<long>")


def _picked(met: DataFrame, first: DataFrame, least: int, most: int) -> DataFrame | None:
    """(user_id, place, cluster) of the stars of one round, `most` of a user at most; None without any. met: free rows only.

    A row is free as long as no chosen head is among its heads, so the rows stay where they are and only counts are shuffled.
    Counts never rise, so heads are chosen in the order of places and a row belongs to the first chosen one it is near.
    """
    own = first.select("user_id", F.col("place").alias("head"))
    # Heads that are near other heads; they go with those' stars.
    under = kept(own.join(met.select("user_id", F.col("place").alias("head"), F.col("heads").alias("under")), ["user_id", "head"], "left"))
    chosen = None
    for _ in range(most):
        free, heads = met, under
        if chosen is not None:
            free = met.join(small(chosen), "user_id").where(~F.arrays_overlap("heads", "chosen") & ~F.array_contains("chosen", F.col("place")))
            heads = under.join(small(chosen), "user_id").where(~F.coalesce(F.arrays_overlap("under", "chosen"), F.lit(False)) & ~F.array_contains("chosen", F.col("head")))
        counts = free.select("user_id", F.explode("heads").alias("head")).groupBy("user_id", "head").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least)
        new = kept(counts.join(heads, ["user_id", "head"], "left_semi").groupBy("user_id").agg(F.min("head").alias("head")))
        if new.isEmpty():
            break
        # Users without a new star have no more in this round, but keep those they have.
        if chosen is None:
            chosen = kept(new.select("user_id", F.array("head").alias("chosen")))
        else:
            chosen = kept(chosen.join(new, "user_id", "left").select("user_id", F.when(F.col("head").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("head"))).alias("chosen")))
    if chosen is None:
        return None
    both = met.join(small(chosen), "user_id").withColumn("mine", F.array_intersect("heads", "chosen"))
    members = both.where((F.size("mine") > 0) & ~F.array_contains("chosen", F.col("place"))).select("user_id", "place", F.array_min("mine").alias("cluster"))
    return members.unionByName(chosen.select("user_id", F.explode("chosen").alias("place")).withColumn("cluster", F.col("place")))


def _rounds(rows: DataFrame, near: Near, least: int, most: int, heads: int, block: int) -> DataFrame:
    """Users of many rows (with part and parts): user_id, place and the place of the star's first row."""
    rows = kept(rows)
    key = ["user_id", "place"]
    taken = rows.select(*key, F.col("place").alias("cluster")).where("false")
    order = Window.partitionBy("user_id").orderBy("place")
    waiting, sparse, thinned, now = rows.select(*key), [], False, heads
    while True:
        full = taken.groupBy("user_id").agg(F.countDistinct("cluster").alias("stars")).where(F.col("stars") >= most).select("user_id")
        waiting = kept(waiting.join(taken, key, "left_anti").join(full, "user_id", "left_anti"))
        first = kept(waiting.withColumn("r", F.row_number().over(order)).where(F.col("r") <= now).drop("r"))
        if first.isEmpty():
            if thinned or not sparse:
                return taken
            # What was a head before leads no star and is in none of a later head.
            left = kept(reduce(DataFrame.unionByName, sparse).join(full, "user_id", "left_anti"))
            if left.isEmpty():
                return taken
            waiting, thinned, now = _leaders(rows.join(small(left), key, "left_semi"), near, least), True, heads
            continue
        few = small(first)
        users = first.select("user_id").distinct()
        met = kept(_met(rows.join(small(users), "user_id", "left_semi"), rows.join(few, key, "left_semi"), near).join(taken, key, "left_anti"))
        stars = _picked(met, first, least, most)
        waiting = waiting.join(few, key, "left_anti")
        if not thinned:
            none = users if stars is None else users.join(stars.select("user_id").distinct(), "user_id", "left_anti")
            none = kept(none)
            sparse.append(waiting.join(small(none), "user_id", "left_semi"))
            waiting = waiting.join(small(none), "user_id", "left_anti")
        if stars is not None:
            taken = kept(taken.unionByName(stars))
        now = min(4 * now, max(block, heads))


def star_clusters(rows: DataFrame, config: EngineConfig = DEFAULT, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """user_id, id and cluster (the place of its first row). rows: user_id, id, place, vector, words.

    Vectors of another size than the user's longest count as none, as do those without length.
    """
    near, least, most = Near(config.cluster_similarity, config.cluster_overlap), config.cluster_min_size, config.max_clusters
    rows = kept(rows)
    sizes = kept(rows.groupBy("user_id").agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim"), F.max("place").alias("last")))
    sized = rows.join(sizes, "user_id").withColumn("vector", F.when(F.size("vector") == F.col("dim"), F.col("vector").cast("array<double>")))
    narrow = sized.select("user_id", F.col("place").cast("long").alias("place"), "vector", "words", "rows", "last")
    found = _whole(narrow.where(F.col("rows") <= block).drop("rows", "last"), near, least, most)
    if not sizes.where(F.col("rows") > block).isEmpty():
        part = lambda c: F.floor(F.col(c) / block).cast("long")
        large = narrow.where(F.col("rows") > block).select("user_id", "place", "vector", "words", part("place").alias("part"), part("last").alias("parts"))
        # A user's first max_clusters stars by place are those that the loop finds before it stops.
        order = F.dense_rank().over(Window.partitionBy("user_id").orderBy("cluster"))
        found = found.unionByName(_rounds(large, near, least, most, heads, block).withColumn("r", order).where(F.col("r") <= most).drop("r"))
    return rows.select("user_id", "id", F.col("place").cast("long").alias("place")).join(found, ["user_id", "place"]).select("user_id", "id", "cluster")
