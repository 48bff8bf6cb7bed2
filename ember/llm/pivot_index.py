"""Exact top-k inner products through a pivot-distance index.

Vectors are scaled to whole numbers, keyed by their nearest pivot and, within
its cell, by distance to it: cell and distance give annuli.  By the triangle
inequality no vector x of an annulus lies nearer to a query q than
``lb = max(0, d(q, pivot) - far, near - d(q, pivot))``, and since
``2 q.x = |q|^2 + |x|^2 - |q - x|^2`` its score is at most
``(|q|^2 + max |x|^2 - lb^2) / 2``.  A query visits annuli in order of that
bound; those whose bound lies under its k-th score are never visited, and inside
an annulus only the window of pivot distances that can still reach it is scored.

Annuli are split into shards of bounded size, so no cell is ever one task, and
queries meet shards in blocks.  Vectors that are null, empty or hold null or
non-finite components take no part, nor do rows without ``vec_id`` or with
another length than the most frequent one.  Equal scores go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.llm.common import stored
from ember.llm.vectors import common_size, sound, unpacked

PIVOTS, RINGS = 32, 8
SHARD, BLOCK = 4096, 2048
SLACK = 1e-6


def _keyed(vectors: DataFrame, dtype: str, pivots: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value.astype(np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), dtype=np.int64)
            exact = x.astype(np.float64)
            norm = (exact**2).sum(axis=1)
            square = norm[:, None] + (centre**2).sum(axis=1) - 2 * exact @ centre.T
            cell = square.argmin(axis=1)
            dist = np.sqrt(((exact - centre[cell]) ** 2).sum(axis=1))
            packed = [row.tobytes() for row in x.astype(dtype)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("is_query"), pa.array(cell, pa.int32()), pa.array(dist), pa.array(norm), pa.array(packed, pa.binary())],
                ["vec_id", "is_query", "cell", "dist", "norm", "vec"],
            )

    return vectors.mapInArrow(run, "vec_id bigint, is_query boolean, cell int, dist double, norm double, vec binary")


class Annuli:
    """Bounds of at most ``pivots * rings`` annuli, ordered per query."""

    def __init__(self, rows: list, pivots: np.ndarray) -> None:
        self.cell, self.ring, self.parts, self.count, self.near, self.far, self.top = (np.array([r[i] for r in rows]) for i in range(7))
        self.pivots = pivots.astype(np.float64)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the score and distances to the annuli's pivots."""
        d = np.sqrt(((self.pivots - q) ** 2).sum(axis=1))[self.cell]
        low = np.maximum(0, np.maximum(d - self.far, self.near - d)) * (1 - SLACK)
        square = (q**2).sum()
        return (square + self.top - low**2) / 2 + SLACK * (square + self.top + 1), d

    def first(self, bound: np.ndarray, k: int) -> np.ndarray:
        """The annuli with the best bounds that hold enough vectors for a k-th score."""
        order = np.argsort(-bound, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.count[order]), 8 * k + 1)) + 1]


def _visits(queries: DataFrame, annuli: Annuli, dtype: str, k: int, later: bool) -> DataFrame:
    """Rows ``(query, shard)``: the first annuli, or all others that can reach the floor."""
    shared = queries.sparkSession.sparkContext.broadcast(annuli)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at, cell, ring, part, dq = [], [], [], [], []
            floors = batch.column("floor").to_pylist()
            for i, q in enumerate(unpacked(batch.column("vec"), dtype).astype(np.float64) if batch.num_rows else []):
                bound, d = index.bounds(q)
                chosen = index.first(bound, k)
                if later:
                    floor = -np.inf if floors[i] is None else floors[i]
                    chosen = np.setdiff1d(np.flatnonzero(bound >= floor), chosen)
                for a in chosen:
                    n = int(index.parts[a])
                    at += [i] * n
                    cell += [index.cell[a]] * n
                    ring += [index.ring[a]] * n
                    part += range(n)
                    dq += [d[a]] * n
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(take), batch.column("block").take(take), batch.column("vec").take(take), batch.column("floor").take(take), pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(part, pa.int32()), pa.array(dq, pa.float64())],
                ["query_id", "block", "vec", "floor", "cell", "ring", "part", "dq"],
            )

    return queries.mapInArrow(run, "query_id bigint, block int, vec binary, floor bigint, cell int, ring int, part int, dq double")


def _scored(visits: DataFrame, shards: DataFrame, dtype: str, exact: bool, k: int) -> DataFrame:
    """The k best of every visited shard per query; groups are one shard by one query block."""
    keys = ["cell", "ring", "part", "block"]
    wanted = visits.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = (F.col("cell") == F.col("_cell")) & (F.col("ring") == F.col("_ring")) & (F.col("part") == F.col("_part"))
    copies = shards.join(wanted, same).select("_cell", "_ring", "_part", "_block", "vec_id", "dist", "norm", "vec")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("dist").to_numpy(), kind="stable")
            dist, ids = right.column("dist").to_numpy()[order], right.column("vec_id").to_numpy()[order]
            top = right.column("norm").to_numpy().max()
            x, q = unpacked(right.column("vec"), dtype)[order], unpacked(left.column("vec"), dtype)
            x, q = (x.astype(np.float64), q.astype(np.float64)) if exact else (x.astype(np.int64), q.astype(np.int64))
            floor = np.array([-np.inf if f is None else f for f in left.column("floor").to_pylist()], dtype=np.float64)
            dq, qid = left.column("dq").to_numpy(), left.column("query_id").to_numpy()
            square = (q.astype(np.float64) ** 2).sum(axis=1)
            reach = np.sqrt(np.maximum(0, square + top - 2 * floor)) * (1 + SLACK) + 1
            for a in range(0, len(q), 256):
                rows = slice(a, a + 256)
                lo = int(np.searchsorted(dist, (dq[rows] - reach[rows]).min(), "left"))
                hi = int(np.searchsorted(dist, (dq[rows] + reach[rows]).max(), "right"))
                if lo >= hi:
                    continue
                score = q[rows] @ x[lo:hi].T
                near = ids[lo:hi]
                for i, s in enumerate(score):
                    s = np.where(near == qid[a + i], -np.inf, s) if exact else s
                    usable = np.flatnonzero(near != qid[a + i])
                    if len(usable) > k:
                        kth = np.partition(s[usable], len(usable) - k)[len(usable) - k]
                        usable = usable[s[usable] >= kth]
                    usable = usable[np.lexsort((near[usable], -s[usable]))][:k]
                    usable = usable[s[usable] >= floor[a + i]]
                    out["query_id"] += [int(qid[a + i])] * len(usable)
                    out["vec_id"] += near[usable].tolist()
                    out["score"] += [int(v) for v in s[usable]]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return visits.groupBy(*keys).cogroup(copies.groupBy(*[f"_{c}" for c in keys])).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_inner_products(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, pivots: int = PIVOTS, rings: int = RINGS, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best whole-number inner products of every query.

    Components are ``floor(scale * x)``.  Scores beyond 63 bits are not defined.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    good = vectors.where(sound(F.col(column)) & F.col("vec_id").isNotNull())
    size = common_size(good, column)
    whole = good.where(F.size(column) == size).select(F.col("vec_id").cast("bigint").alias("vec_id"), is_query.alias("is_query"), F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    centres = np.array([r["v"] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()], dtype=np.int64)
    if not len(centres):
        return spark.createDataFrame([], schema)
    widest = whole.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    dtype = "<i2" if widest < 2**15 else "<i4" if widest < 2**31 else "<i8"
    keyed = stored(_keyed(whole, dtype, centres), "keyed")
    spread = keyed.groupBy("cell").agg(F.min("dist").alias("_lo"), F.max("dist").alias("_hi")).withColumnRenamed("cell", "_cell")
    ring = F.least(F.floor((F.col("dist") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9) * rings), F.lit(rings - 1)).cast("int")
    placed = keyed.join(F.broadcast(spread), F.col("cell") == F.col("_cell")).withColumn("ring", ring).drop("_cell", "_lo", "_hi")
    stats = placed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"), F.count(F.lit(1)), F.min("dist"), F.max("dist"), F.max("norm"))
    rows = stats.orderBy("cell", "ring").collect()
    annuli = Annuli(rows, centres)
    parts = spark.createDataFrame([(int(r[0]), int(r[1]), int(r[2])) for r in rows], "cell int, ring int, parts int")
    shards = placed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = keyed.where("is_query")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), "vec")

    exact = float(widest) ** 2 * size < 2**53
    opening = stored(_scored(_visits(asked.withColumn("floor", F.lit(None).cast("bigint")), annuli, dtype, k, False), shards, dtype, exact, k), "opening")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = opening.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
    floors = asked.join(floors, F.col("query_id") == F.col("_q"), "left").drop("_q")
    rest = _scored(_visits(floors, annuli, dtype, k, True), shards, dtype, exact, k)
    ranked = opening.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
