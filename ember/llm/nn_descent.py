"""Approximate nearest neighbours: a neighbour graph by NN-descent and greedy search.

Building.  Equal vectors are one node.  A first graph comes from random
hyperplane cells and from seeded random groups, so every node has neighbours.
Every round joins neighbours of neighbours: edges in both directions are joined
to the vectors, members of one centre are compared with each other, and a pair is
sent on only if it comes before the last neighbour of a list.  Lists keep the
``degree`` first neighbours by distance, then id.  A centre with many members is split into parts that are dealt anew
each round, so no group is unbounded and none is dropped.

Searching.  Each query keeps its ``beam`` nearest nodes so far and expands, in
every round, the nearest of them that it has not expanded, over edges of both
directions, until none is left.  Distances are computed in double precision on
the original vectors.  Queries that end with fewer than ``k`` rows, or all others
if there are fewer, are compared with all nodes in blocks.

Null, empty and zero vectors and those with null or non-finite components take
no part, nor rows without ``vec_id`` or of another length than the most frequent
one.  Of rows with equal ``vec_id`` the smallest vector takes part.  Equal
distances go to the smaller ``vec_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.llm.common import stored
from ember.llm.vectors import common_size, sound

TABLES, CELL = 3, 256
PART, BUCKET, BLOCK = 128, 512, 4096
RANDOM, GROUP = 2, 32  # tables of random groups of about GROUP nodes


def _packed(vectors: DataFrame, kind: str, bits: int, seed: int) -> DataFrame:
    """``id, is_query, vec, cells`` (hyperplane cell per table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], TABLES * bits))
            side = (x @ planes > 0).reshape(len(x), TABLES, bits)
            cells = (side * (1 << np.arange(bits))).sum(axis=2) + (np.arange(TABLES) << bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("is_query"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64()))],
                ["id", "is_query", "vec", "cells"],
            )

    return vectors.mapInArrow(run, "id bigint, is_query boolean, vec binary, cells array<bigint>")


def _doubles(vec: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), dtype=kind).reshape(len(vec), -1).astype(np.float64)


def _better(ids: np.ndarray, x: np.ndarray, last: np.ndarray, last_id: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per member the ``most`` first others by distance and id that come before its last neighbour: positions, ids and squared distances."""
    centred = x - x.mean(axis=0)  # near copies keep their digits
    square = (centred**2).sum(axis=1)
    d = np.maximum(square[:, None] + square - 2 * centred @ centred.T, 0)
    # room for rounding; what passes is measured exactly
    slack = 1e-13 * (square[:, None] + square)
    np.fill_diagonal(d, np.inf)
    good = (d - slack <= last[:, None]) & np.isfinite(d)
    if len(ids) > most + 1:
        bound = np.partition(d + slack, most - 1, axis=1)[:, most - 1]
        good &= d - slack <= bound[:, None]
    i, j = np.nonzero(good)
    exact = np.empty(len(i))
    for a in range(0, len(i), BLOCK):
        exact[a : a + BLOCK] = ((x[i[a : a + BLOCK]] - x[j[a : a + BLOCK]]) ** 2).sum(axis=1)
    before = (exact < last[i]) | ((exact == last[i]) & (ids[j] < last_id[i]))
    i, j, exact = i[before], j[before], exact[before]
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[kept], ids[j[kept]], exact[kept]


def _local_joins(members: DataFrame, keys: list[str], centre: str, degree: int, kind: str) -> DataFrame:
    """Compare the members of every centre: ``u, v, d`` in arrays per member."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(centre)
        at = table.column(centre).to_numpy()
        ids, last, last_id, x = table.column("m").to_numpy(), table.column("last").to_numpy(), table.column("last_id").to_numpy(), table.column("vec")
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        u, v, d = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i, near, dist = _better(ids[a:b], _doubles(x.slice(a, b - a), kind), last[a:b], last_id[a:b], degree)
            u.append(ids[a:b][i])
            v.append(near)
            d.append(dist)
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v), "d": np.concatenate(d)})

    return members.groupBy(*keys).applyInArrow(run, "u bigint, v bigint, d double")


def _merged(found: DataFrame, lists: DataFrame | None, buckets: int, degree: int) -> DataFrame:
    """New lists: the ``degree`` nearest of old and found neighbours, per bucket of nodes."""
    if lists is not None:
        old = lists.select("u", F.explode(F.arrays_zip("vs", "ds")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.ds").alias("d"))
        found = found.unionByName(old)

    def run(table: pa.Table) -> pa.Table:
        u, v, d = (table.column(c).to_numpy() for c in ("u", "v", "d"))
        order = np.lexsort((d, v, u))
        u, v, d = u[order], v[order], d[order]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, d = u[first], v[first], d[first]
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        u, v, d = u[rank < degree], v[rank < degree], d[rank < degree]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        ends = pa.array(np.append(start, len(u)), pa.int32())
        return pa.table({"u": u[start], "vs": pa.ListArray.from_arrays(ends, pa.array(v)), "ds": pa.ListArray.from_arrays(ends, pa.array(d, pa.float64()))})

    bucket = F.pmod(F.xxhash64("u"), F.lit(buckets)).cast("int").alias("bucket")
    return found.select("u", "v", "d", bucket).groupBy("bucket").applyInArrow(run, "u bigint, vs array<bigint>, ds array<double>")


def _edges(lists: DataFrame) -> DataFrame:
    """Distinct edges ``c, m`` of both directions."""
    out = lists.select(F.col("u").alias("c"), F.explode("vs").alias("m"))
    return out.unionByName(out.select(F.col("m").alias("c"), F.col("c").alias("m"))).distinct()


def build_graph(nodes: DataFrame, n: int, kind: str, degree: int = 24, rounds: int = 4, seed: int = 5) -> DataFrame:
    """Neighbour lists ``u, vs, ds`` (nearest first) of all ``nodes`` (see ``_packed``)."""
    buckets = max(1, -(-n // (4 * BUCKET)))
    tasks = max(1, -(-n // BUCKET))
    groups = max(1, n // GROUP)
    plain = nodes.select(F.col("id").alias("m"), "vec")
    # random groups have negative numbers; small ones share a task
    drawn = [F.lit(-1 - t * groups) - F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(groups)) for t in range(RANDOM)]
    cells = nodes.select(F.col("id").alias("m"), "vec", F.explode(F.concat("cells", F.array(*[c.cast("bigint") for c in drawn]))).alias("cell"))
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL)).cast("int").alias("_parts")).withColumnRenamed("cell", "_cell")
    cells = cells.join(parts, F.col("cell") == F.col("_cell")).withColumn("part", F.pmod(F.xxhash64("m", "cell"), F.col("_parts")).cast("int"))
    task = F.when(F.col("cell") < 0, F.lit(-1) - F.pmod(F.xxhash64("cell"), F.lit(RANDOM * tasks))).otherwise(F.col("cell"))
    none = [F.lit(float("inf")).alias("last"), F.lit(0).cast("bigint").alias("last_id")]
    first = cells.select("m", "vec", "cell", "part", task.cast("bigint").alias("task"), *none)
    lists = stored(_merged(_local_joins(first, ["task", "part"], "cell", degree, kind), None, buckets, degree), "graph")
    for turn in range(rounds):
        edges = _edges(lists)
        full = lists.where(F.size("ds") >= degree).select(F.col("u").alias("_u"), F.element_at("ds", -1).alias("last"), F.element_at("vs", -1).alias("last_id"))
        known = plain.join(full, F.col("m") == F.col("_u"), "left")
        known = known.select(F.col("m").alias("_m"), "vec", F.coalesce("last", F.lit(float("inf"))).alias("last"), F.coalesce("last_id", F.lit(0).cast("bigint")).alias("last_id"))
        hubs = edges.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART).select(F.col("c").alias("_c"), F.ceil(F.col("_n") / PART).alias("_parts"))
        members = edges.join(known, F.col("m") == F.col("_m")).join(hubs, F.col("c") == F.col("_c"), "left")
        part = F.coalesce(F.pmod(F.xxhash64("m", F.lit(turn)), F.col("_parts")), F.lit(0)).cast("int")
        bucket = F.pmod(F.xxhash64("c"), F.lit(tasks)).cast("int")
        members = members.select("c", "m", "vec", "last", "last_id", part.alias("part"), bucket.alias("bucket"))
        lists = stored(_merged(_local_joins(members, ["bucket", "part"], "c", degree, kind), lists, buckets, degree), "graph")
    return lists


def _distances(wanted: DataFrame, nodes: DataFrame, kind: str, n: int, most: int, bounds: DataFrame | None = None) -> DataFrame:
    """Squared distances of queries to wanted nodes: ``q, v, d``, per block of nodes.

    With ``bounds`` (``q, bound``) only nodes nearer than the bound come back.
    """
    blocks = max(1, -(-n // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    asked = wanted.groupBy("q", block("v").alias("block")).agg(F.collect_set("v").alias("vs"))
    asked = asked.join(nodes.select(F.col("id").alias("_q"), F.col("vec").alias("qvec")), F.col("q") == F.col("_q")).select("q", "block", "vs", "qvec")
    if bounds is None:
        asked = asked.withColumn("bound", F.lit(float("inf")))
    else:
        asked = asked.join(bounds.select(F.col("q").alias("_q"), "bound"), F.col("q") == F.col("_q"), "left").select("q", "block", "vs", "qvec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)
            x = np.frombuffer(b"".join(right.column("vec").to_pylist()), dtype=kind).reshape(len(ids), -1)
            for i, vec, near, bound in zip(left.column("q").to_pylist(), left.column("qvec"), left.column("vs"), left.column("bound").to_pylist(), strict=True):
                near = near.values.to_numpy()
                rows = order[np.searchsorted(ids, near, sorter=order)]
                diff = x[rows].astype(np.float64) - np.frombuffer(vec.as_py(), dtype=kind).astype(np.float64)
                dist = np.einsum("ij,ij->i", diff, diff)
                near, dist = near[dist < bound], dist[dist < bound]
                if len(near) > most:
                    kept = np.argpartition(dist, most)[:most]
                    near, dist = near[kept], dist[kept]
                q.append(np.full(len(near), i))
                v.append(near)
                d.append(dist)
        return pa.table({"q": np.concatenate(q), "v": np.concatenate(v), "d": np.concatenate(d)})

    held = nodes.select("id", "vec", block("id").alias("_block"))
    return asked.groupBy("block").cogroup(held.groupBy("_block")).applyInArrow(run, "q bigint, v bigint, d double")


def greedy_search(nodes: DataFrame, lists: DataFrame, n: int, kind: str, beam: int = 400, width: int = 128, max_rounds: int = 40) -> DataFrame:
    """The ``beam`` nearest nodes found for every query: ``q, v, d`` (squared distance)."""
    graph = stored(_edges(lists), "edges")
    best = Window.partitionBy("q").orderBy("d", "v")
    queries = nodes.where("is_query").select(F.col("id").alias("q"))
    # a query starts from its own neighbours and expands itself first
    found = queries.join(graph, F.col("q") == F.col("c")).select("q", F.col("m").alias("v"))
    state = _distances(found, nodes, kind, n, beam).withColumn("expanded", F.lit(False))
    state = stored(state.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).drop("_r"), "beam")
    for _ in range(max_rounds):
        fresh = state.where(~F.col("expanded")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= width).select("q", "v")
        fresh = stored(fresh, "fresh")
        if fresh.isEmpty():
            break
        near = fresh.join(graph, F.col("v") == F.col("c")).select("q", F.col("m").alias("v")).where("q <> v").distinct()
        near = near.join(state.select("q", "v"), ["q", "v"], "left_anti")
        # a full beam admits only what is nearer than its last node
        bounds = state.groupBy("q").agg(F.count(F.lit(1)).alias("_n"), F.max("d").alias("bound")).where(F.col("_n") >= beam)
        more = _distances(near, nodes, kind, n, beam, bounds).withColumn("expanded", F.lit(False))
        done = state.unionByName(more).unionByName(fresh.select("q", "v", F.lit(None).cast("double").alias("d"), F.lit(True).alias("expanded")))
        done = done.groupBy("q", "v").agg(F.min("d").alias("d"), F.max("expanded").alias("expanded"))
        state = stored(done.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam).drop("_r"), "beam")
    return state.select("q", "v", "d")


def _scan(wanted: DataFrame, nodes: DataFrame, kind: str, n: int, most: int) -> DataFrame:
    """The ``most`` nearest nodes of every ``q`` in each block of nodes: ``q, v, d``, compared exactly."""
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-wanted.count() // CELL))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = wanted.join(nodes.select(F.col("id").alias("_q"), F.col("vec").alias("qvec")), F.col("q") == F.col("_q")).select("q", "qvec", deal("q", parts).alias("part"), every(blocks).alias("block"))
    held = nodes.select("id", "vec", deal("id", blocks).alias("_block"), every(parts).alias("_part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids, x = right.column("id").to_numpy(), _doubles(right.column("vec"), kind)
            for i, vec in zip(left.column("q").to_pylist(), _doubles(left.column("qvec"), kind), strict=True):
                diff = x - vec
                dist = np.einsum("ij,ij->i", diff, diff)
                order = np.lexsort((ids, dist))
                order = order[ids[order] != i][:most]
                q.append(np.full(len(order), i))
                v.append(ids[order])
                d.append(dist[order])
        return pa.table({"q": np.concatenate(q), "v": np.concatenate(v), "d": np.concatenate(d)})

    return asked.groupBy("part", "block").cogroup(held.groupBy("_part", "_block")).applyInArrow(run, "q bigint, v bigint, d double")


def _named(found: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` first rows of every query node by score and id, its own among them: ``q, v, score``.

    Of equal vectors only the ``k + 1`` smallest ids can be among them.
    """
    near = found.withColumn("score", F.sqrt("d")).withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "v"))).where(F.col("_r") <= k)
    near = near.select("q", F.col("v").alias("_v"), "score").unionByName(asked.select("q", F.col("q").alias("_v"), F.lit(0.0).alias("score")))
    rows = near.join(members, F.col("_v") == F.col("node")).select("q", F.explode("ids").alias("v"), "score")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "v"))).where(F.col("_r") <= k + 1).drop("_r")


def nearest(vectors: DataFrame, is_query: Column, k: int, column: str = "embedding", degree: int = 24, rounds: int = 4, beam: int = 400, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query."""
    spark = vectors.sparkSession
    zero = F.forall(column, lambda x: x == 0)
    good = vectors.where(sound(F.col(column)) & ~zero & F.col("vec_id").isNotNull())
    size = common_size(good, column)
    good = good.where(F.size(column) == size).select(F.col("vec_id").cast("bigint").alias("id"), is_query.alias("is_query"), F.col(column).alias("v"))
    good = good.groupBy("id").agg(F.max("is_query").alias("is_query"), F.min("v").alias("v"))
    # equal vectors are known by two hashes of 64 bits
    good = stored(good.select("id", "is_query", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(seed), "v").alias("b")), "rows")
    n = good.count()
    if n < 2:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    bits = max(1, int(np.ceil(np.log2(max(2, n / CELL)))))
    single = good.groupBy("a", "b").agg(F.min(F.struct("id", "v")).alias("_f"), F.max("is_query").alias("is_query")).select("_f.id", "is_query", "_f.v")
    nodes = stored(_packed(single, kind, min(bits, 40), seed), "nodes")
    few = good.select("id", "a", "b").withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))).where(F.col("_r") <= k + 1)
    members = stored(few.groupBy("a", "b").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")), "members")
    asked = nodes.where("is_query").select(F.col("id").alias("q"))
    found = greedy_search(nodes, build_graph(nodes, n, kind, degree, rounds, seed), n, kind, max(beam, k))
    rows = stored(_named(found, members, asked, k), "found")
    short = rows.groupBy("q").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min(k + 1, n)).select("q")
    short = stored(short, "short")
    if not short.isEmpty():
        whole = _named(_scan(short, nodes, kind, n, k), members, short, k)
        rows = rows.join(short, "q", "left_anti").unionByName(whole)
    queries = good.where("is_query").select(F.col("id").alias("query_id"), "a", "b").join(members, ["a", "b"]).select("query_id", "node")
    rows = queries.join(rows, F.col("node") == F.col("q")).where("v <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "v"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("v").alias("vec_id"), "score")
