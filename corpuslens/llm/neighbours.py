"""Operator 4: nearest neighbours by inner product with collision counting over query-centred windows.

Rows are dealt into blocks by hash. A block keeps, for each of PROJECTIONS random directions, its rows sorted by that
one projection. A query's window in every sorted array is centred at the query's own projection; all windows grow
together by a fixed factor (virtual rehashing: wider windows over the same arrays), and a row collides once for each
window that holds it. Rows of COLLISIONS or more collisions are candidates; windows grow until CANDIDATES of the block
are such (or all of it), and every candidate is verified with the inner product in double precision - no cap on ties or
on copies, which collide alike. The blocks' best k meet in one ranking.

Inner product becomes distance by one more coordinate: rows are scaled by the largest norm and completed to unit length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_stream, stage

#: Rows of a block, about.
BLOCK = 8192
PROJECTIONS = 96
#: Share of the projections on which a candidate collides.
COLLISIONS = 0.65
#: Share of a block that is verified at least, and so many rows besides: in small blocks the nearest stand out less.
CANDIDATES, LEAST = 0.075, 256
START, GROW, PROBES = 0.2, 1.12, 16


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(77).standard_normal((dim + 1, projections))


class Index:
    """The sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.directions = directions(vectors.shape[1])
        scaled = self.vectors / norm
        last = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
        projected = scaled @ self.directions[:-1] + last[:, None] * self.directions[-1]
        order = np.argsort(projected, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(projected.T, order, axis=1)
        #: place of each row in each sorted array: a window is a range of places
        self.kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, self.kind)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.kind)[None, :], axis=1)
        self.enough, self.need = int(np.ceil(COLLISIONS * len(order))), min(len(ids), int(CANDIDATES * len(ids)) + LEAST)
        # where windows begin to grow: one step before the narrowest that some of the block's own rows need
        self.start = START
        probes = self.vectors[:: max(1, len(ids) // PROBES)][:PROBES]
        self.start = max(START, min(width for _, width in self.candidates(probes)) / GROW)

    def windows(self, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries, projections): where the window of each query begins and ends in each sorted array."""
        low = [s.searchsorted(c - width, "left") for s, c in zip(self.sorted, centres.T, strict=True)]
        high = [s.searchsorted(c + width, "right") for s, c in zip(self.sorted, centres.T, strict=True)]
        return np.stack(low, axis=1), np.stack(high, axis=1)

    def candidates(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """For each query the positions of the rows that collide often enough, at least CANDIDATES of the block, and the windows' last width."""
        n = len(self.ids)
        centres = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ self.directions[:-1]
        for centre, low, high in zip(centres, *self.windows(centres, self.start), strict=True):
            width = self.start
            while True:
                inside = (self.place - low.astype(self.kind)[:, None]) < (high - low).astype(self.kind)[:, None]
                found = np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= self.enough)
                if len(found) >= self.need or (low.max() == 0 and high.min() == n):
                    yield found, width
                    break
                width *= GROW
                (low,), (high,) = self.windows(centre[None, :], width)

    def search(self, query_ids: list[int], queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each query's id with ids and inner products of the k best candidates, best first, ties to smaller ids."""
        for query_id, query, (found, _) in zip(query_ids, queries, self.candidates(queries), strict=True):
            found = found[self.ids[found] != query_id]
            scores = np.einsum("ij,j->i", self.vectors[found], query)
            ids = self.ids[found]
            if len(found) > 4 * k:  # all that may be among the best, ties with the last of them too
                top = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                ids, scores = ids[top], scores[top]
            best = np.lexsort((ids, -scores))[:k]
            yield query_id, ids[best], scores[best]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Rows take no part when the id is null or the vector is null, empty, all zero, or holds a null or a non-finite
    component. Only vectors of equal length are compared. Rows with the query's id are not its neighbours; other repeated
    rows are candidates each. Fewer than k candidates are all returned; no rows give none.
    """
    spark = vectors.sparkSession
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null").where(F.coalesce(sound, F.lit(False)))
    clean = stage(spark, clean.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    norms = clean.select("dim", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n")).groupBy("dim").agg(F.max("n").alias("norm"), F.count("*").alias("rows"))
    # one row for each length of vector
    sized = clean.join(norms.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")), "dim")
    base = sized.select("dim", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), "id", "norm", "v")
    asked = sized.where(F.col("id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("query"), "id", "norm", "v")
    both = base.union(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, block, query, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(block) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)])), strict=True):
                if group != (dim[a], block[a]):
                    group, held, index = (dim[a], block[a]), [], None
                part = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, dim[a])
                if not query[a]:
                    held.append((ids[a:b], part))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = Index(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), batch.column(4)[a].as_py())
                    held = []
                found = list(index.search(ids[a:b].tolist(), part, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "vec_id", "score"]
                )

    local = arrow_stream(both, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
