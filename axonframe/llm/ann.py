"""Approximate nearest neighbours by collision counting with virtual rehashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class Settings:
    """projections: single-projection sorted arrays a block has. threshold: collisions, of that many, from which a
    vector is verified. share, least: part of a block, and number of its vectors, that are verified, besides k, before a
    search ends there. sample: vectors of a block whose collisions say how the windows widen, `step` of them at a time.
    sure: half width of the windows, over the distance up to which nearly all vectors are verified by then.
    block: rows of a block of vectors, which bounds the memory of a task."""

    projections: int = 192
    threshold: int = 150
    share: float = 0.04
    least: int = 256
    sample: int = 512
    step: int = 5
    sure: float = 1.5
    block: int = 16384
    seed: int = 7


class SortedArrays:
    """Sorted projections of a block of vectors, and searches in it."""

    def __init__(self, vectors: np.ndarray, s: Settings):
        self.vectors, self.s = vectors, s
        rng = np.random.default_rng(s.seed)
        self.lines = rng.standard_normal((s.projections, vectors.shape[1]))
        at = vectors @ self.lines.T
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        # all arrays as one, each moved past the end of the one before it, so that one search finds the ends of all windows
        self.far = 4 * float(np.abs(at).max()) + 1
        self.moved = self.far * np.arange(s.projections)
        self.sorted = (np.take_along_axis(at.T, self.order, axis=1) + self.moved[:, None]).ravel()
        self.sample = at[rng.permutation(len(vectors))[: s.sample]]

    def _places(self, values: np.ndarray, side: str) -> np.ndarray:
        moved = np.clip(values, -self.far / 2, self.far / 2) + self.moved
        return np.searchsorted(self.sorted, moved, side=side) - len(self.vectors) * np.arange(self.s.projections)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and distances of the k nearest vectors found, and how many were verified.

        Windows centred on the query's projections widen step by step (virtual rehashing: a step counts only what it
        adds); a vector that collides in `threshold` windows is verified by its distance. The half widths are those at
        which more and more of a sample of the block would be. It ends when a share of the block is verified, when the
        kth distance is so small for the windows that nearly all nearer vectors are, or when the windows hold everything.
        """
        s, n = self.s, len(self.vectors)
        centre = self.lines @ query
        widths = np.sort(np.partition(np.abs(self.sample - centre), s.threshold - 1, axis=1)[:, s.threshold - 1])
        count = np.zeros(n, dtype=np.int64)
        verified = np.zeros(n, dtype=bool)
        places, distances = np.empty(0, dtype=np.int64), np.empty(0)
        lo = hi = None
        at, half = s.step, 0.0
        while True:
            half = max(half, float(widths[at])) if at < len(widths) else 2 * half + self.far * 1e-3
            reach = half + self.far * 1e-12  # equal vectors may be projected a little apart
            new_lo, new_hi = self._places(centre - reach, "left"), self._places(centre + reach, "right")
            if lo is None:  # the first windows hold more than they leave out
                outside = [self.order[i, x:y] for i in range(s.projections) for x, y in ((0, new_lo[i]), (new_hi[i], n))]
                count += s.projections - np.bincount(np.concatenate(outside), minlength=n)
            else:
                added = [self.order[i, x:y] for i in range(s.projections) for x, y in ((new_lo[i], lo[i]), (hi[i], new_hi[i]))]
                count += np.bincount(np.concatenate(added), minlength=n)
            lo, hi, at = new_lo, new_hi, at + s.step
            fresh = np.flatnonzero((count >= s.threshold) & ~verified)
            verified[fresh] = True
            places = np.concatenate([places, fresh])
            distances = np.concatenate([distances, np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1))])
            if len(places) == n or len(places) >= max(s.least, k + s.share * n):
                break
            if len(places) >= k and np.partition(distances, k - 1)[k - 1] <= half / s.sure:
                break
        best = np.lexsort((places, distances))[: 4 * k]
        return places[best], distances[best], len(places)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part: the vector is not null, not empty, not zero, and all parts are finite."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("vec").isNotNull() & F.col("id").isNotNull() & finite & F.exists(F.col("vec"), lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest vectors found.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Vectors that are
    null, empty, zero or hold null or non-finite parts take no part, and rows with a null id do not either; vectors are
    compared with queries of their own number of parts. Ties go to the smaller id; rows that repeat an id are each
    candidates, also of a query with their id, and a query id that repeats is asked once, with the first of its vectors.
    With under k candidates all come back. An empty table gives an empty result; other columns are ignored.

    Vectors are dealt out by number into blocks, a task each, where their sorted arrays are built once; all queries go to
    every block, some at a time, and each block gives its k best for each, which are ranked together. So a vector is
    moved once, and what grows with the square of the table is queries times blocks.
    """
    rows = written(usable(vectors, id_col, vector).withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers that stay, once written
    blocks = max(1, -(-rows.count() // s.block))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "row")).alias("q"))
    asked = written(asked.select("id", "q.vec", F.size("q.vec").alias("dim"), "q.row"), "queries")
    schema = "query_id long, vec_id long, score double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held, index = None, [], None
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("asks", "dim", "id", "row")}
            cut = np.flatnonzero((np.diff(columns["dim"]) != 0) | (np.diff(columns["asks"]) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(batch)]):
                if hi == lo:
                    continue
                if columns["dim"][lo] != dim:
                    dim, held, index = columns["dim"][lo], [], None
                table = batch.column("vec").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
                ids, places = columns["id"][lo:hi], columns["row"][lo:hi]
                if not columns["asks"][lo]:
                    held.append((table, ids, places))
                    continue
                if not held:
                    continue
                if index is None:
                    table_of, ids_of, rows_of = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((rows_of, ids_of))  # places tell ties apart as ids do
                    index, ids_of, rows_of = SortedArrays(table_of[order], s), ids_of[order], rows_of[order]
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for query, own, query_id in zip(table, places, ids):
                    near, scores, _ = index.search(query, k + 1)
                    others = np.flatnonzero(rows_of[near] != own)[:k]
                    found.append((np.full(len(others), query_id), ids_of[near[others]], scores[others]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    both = rows.select(block, F.lit(False).alias("asks"), "dim", "id", "row", "vec").unionByName(asked.select(every_block, F.lit(True).alias("asks"), "dim", "id", "row", "vec"))
    dealt = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("dim", "asks", "id", "row")
    met = dealt.select("asks", "dim", "id", "row", "vec").mapInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(vectors: dict[int, np.ndarray], k: int, every: int) -> Iterator[tuple[int, int, int, float]]:
    """The same from all distances; for tests and for measuring recall on small tables."""
    ids = np.array(sorted(vectors))
    table = np.stack([vectors[i] for i in ids])
    for query in ids[ids % every == 0]:
        distances = np.sqrt(((table - vectors[query]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, distances)) if ids[i] != query][:k]
        yield from ((int(query), r + 1, int(ids[i]), float(distances[i])) for r, i in enumerate(order))
