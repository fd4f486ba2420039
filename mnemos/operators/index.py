"""Exact nearest neighbours through an index of pivots.

A few vectors, far from each other, are pivots; each vector lies in the cell of the nearest one and knows its angle to it. By
the triangle inequality of angles, no vector of a cell can be nearer to a query than the difference of the query's angle to the
pivot and the cell's range of angles. A search scores the nearest cells first, until k vectors are met, which bounds the
k-th angle; then only cells that may hold nearer ones, and in those only vectors whose own angle allows it. The result is
nearest()'s, ties included. Cells are keys of the joins beside the user, so a user of many vectors is spread over them.

Vectors without length, or of another size than the pivots, have no angles: they lie in a cell of their own that is always
scored. Queries without length or of another size score everything that has their size. Users without vectors have no hits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.vector import best_in_blocks, cosine, hinted, norm, small
from mnemos.sources.scratch import kept

PIVOTS, SAMPLE = 32, 4_096
#: Cell of the vectors that have no angle, and what angles may be off by.
LOOSE, SLACK = -1, 1e-6


def far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows that are far from each other, each the farthest from those before it."""
    length = np.linalg.norm(sample, axis=1)
    units = sample[length > 0] / length[length > 0][:, None]
    if not len(units):
        return units
    picked, best = [0], units @ units[0]
    while len(picked) < most and best.min() < 1 - 1e-9:
        picked.append(int(best.argmin()))
        best = np.maximum(best, units @ units[picked[-1]])
    return units[picked]


class VectorIndex:
    """Rows (id, keys, vector, cell, angle) and, for each key and cell, the range of angles and the number of rows."""

    def __init__(self, rows: DataFrame, cells: DataFrame, pivots: np.ndarray, on: Sequence[str], id_col: str):
        self.rows, self.cells, self.pivots, self.on, self.id_col = rows, cells, pivots, list(on), id_col

    @classmethod
    def build(cls, vectors: DataFrame, on: Sequence[str] = ("user_id",), id_col: str = "memory_id", pivots: int = PIVOTS, sample: int = SAMPLE) -> VectorIndex:
        """vectors: id, keys, vector. Pivots come from `sample` vectors at most, picked by a hash of their ids."""
        size = vectors.where("size(vector) > 0").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        dim = size["size"] if size else 0
        some = vectors.where(F.size("vector") == dim).select(F.col("vector").cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(sample).toArrow()["v"]
        own = far_apart(np.array(some.to_pylist(), np.float64).reshape(len(some), dim), pivots)
        placed = vectors.select(id_col, *on, "vector", norm(F.col("vector")).alias("length"), _angles(own, nearest_only=True)(F.col("vector").cast("array<double>")).alias("a"))
        rows = kept(placed.select(id_col, *on, "vector", "length", F.col("a.cell").alias("cell"), F.element_at("a.angles", 1).alias("angle")))
        cells = kept(rows.groupBy(*on, "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")))
        return cls(rows, cells, own, on, id_col)

    def search(self, queries: DataFrame, k: Column | int, query_id: str = "query_id", rows: int | None = None) -> DataFrame:
        """query_id, id, similarity and rank of the k nearest vectors of each query among those of its keys, as nearest() gives."""
        order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), self.id_col)
        plan, rest, hits = self._searched(queries, k, query_id, rows)
        return hits.unionByName(self._best(rest, k, query_id)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def scored_share(self, queries: DataFrame, k: int, query_id: str = "query_id") -> float:
        """The share of all vectors of the queries' keys that a search scores."""
        plan, rest, _ = self._searched(queries, k, query_id, None)
        scored = self._scored(plan.where("first"), query_id).count() + self._scored(rest, query_id).count()
        every = queries.select(*self.on).join(self.cells, self.on).agg(F.sum("n")).first()[0] or 0
        return scored / max(1, every)

    def _searched(self, queries: DataFrame, k: Column | int, query_id: str, rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All cells of each query, those that may hold more than its first ones do, and the nearest vectors of the first ones."""
        angles = _angles(self.pivots)(F.col("vector").cast("array<double>"))
        asked = queries.select(query_id, *self.on, F.col("vector").alias("qv"), norm(F.col("vector")).alias("qn"), angles.alias("a"))
        q = small(kept(asked)) if rows is None else hinted(kept(asked), rows)
        met = q.join(self.cells, self.on)
        own = F.get("a.angles", F.col("cell"))
        # Cells without angles on either side may hold anything.
        low = F.when((F.col("cell") == LOOSE) | own.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), own - F.col("high"), F.col("low") - own))
        met = met.select(query_id, *self.on, "qv", "qn", "cell", "n", own.alias("own"), low.alias("least"))
        before = Window.partitionBy(query_id).orderBy("least", F.coalesce("own", F.lit(0.0)), "cell").rowsBetween(Window.unboundedPreceding, -1)
        plan = kept(met.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) < k))
        order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), self.id_col)
        hits = kept(self._best(plan.where("first"), k, query_id).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))
        reached = hits.groupBy(query_id).agg(F.min("similarity").alias("worst"), F.count("*").alias("met"))
        bound = F.when(F.col("met") >= k, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("worst")))) + SLACK).otherwise(F.lit(4.0))
        rest = plan.where("NOT first").join(reached, query_id, "left").withColumn("bound", F.coalesce(bound, F.lit(4.0))).where("least <= bound")
        return plan, rest, hits

    def _best(self, plan: DataFrame, k: Column | int, query_id: str) -> DataFrame:
        """The nearest vectors, k of each block at least, of the planned cells: a block is scored whole, whatever its angles."""
        if not isinstance(k, int):
            return self._scored(plan, query_id)
        return best_in_blocks(plan, self.rows.select(self.id_col, *self.on, "cell", F.col("vector").alias("v")), k, [*self.on, "cell"], query_id, self.id_col)

    def _scored(self, plan: DataFrame, query_id: str) -> DataFrame:
        """Similarities of the planned cells' vectors that may be within the query's bound (if it has one)."""
        v = self.rows.select(self.id_col, *self.on, "cell", F.col("vector").alias("v"), F.col("length").alias("vn"), F.col("angle"))
        pairs = v.join(small(plan), [*self.on, "cell"]).where(F.size("qv") == F.size("v"))
        if "bound" in plan.columns:
            pairs = pairs.where(F.col("own").isNull() | F.col("angle").isNull() | (F.abs(F.col("own") - F.col("angle")) <= F.col("bound")))
        return pairs.select(query_id, self.id_col, cosine(F.col("qv"), F.col("v"), F.col("qn"), F.col("vn")).alias("similarity"))


def _angles(pivots: np.ndarray, nearest_only: bool = False):
    """A function that gives a vector's nearest pivot (LOOSE: none) and its angles to all pivots, or to that one."""

    @F.arrow_udf("struct<cell: int, angles: array<double>>")
    def angles(vectors: pa.Array) -> pa.Array:
        cells, lists = [], []
        for x in vectors:
            v = np.array(x.as_py() or [], np.float64)
            length = np.linalg.norm(v) if len(v) else 0.0
            if not len(pivots) or len(v) != pivots.shape[1] or not length or not np.isfinite(length):
                cells.append(LOOSE)
                lists.append(None)
                continue
            own = np.arccos(np.clip(pivots @ (v / length), -1, 1))
            cells.append(int(own.argmin()))
            lists.append([float(own.min())] if nearest_only else own.tolist())
        return pa.StructArray.from_arrays([pa.array(cells, pa.int32()), pa.array(lists, pa.list_(pa.float64()))], ["cell", "angles"])

    return angles
