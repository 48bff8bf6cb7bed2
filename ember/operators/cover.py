"""Cover index of polygons: points and boxes meet a few local edges, never a whole ring.

A polygon is cut into horizontal slabs, narrower ones the more edges it has.
In a slab the edges form clusters whose x-ranges overlap; between two clusters
no edge passes, so the whole gap is inside or outside.  A piece of the cover is
either such an inside gap or a cluster with its edges and the state of the gap
to its right.  A point meets exactly one piece of a polygon: in a gap it is
inside, in a cluster the edges of the cluster and that state decide, with the
same arithmetic as over the whole polygon.

Slab borders are multiples of a power of two, so numbering points and edges by
slab is exact.  Rings must be closed (see ``contracts.check_rings``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import geometry as G
from ember.operators.indexing import salted_join
from ember.operators.spatial import blocked_join, box_join

#: Narrowest slabs are 2^-FINEST of a tile.
FINEST = 12


def ring_edges(vertices: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """One row per edge of closed rings (``part, ring, seq, lon, lat``): ``keys, x1, y1, x2, y2``.

    Rows are dealt by polygon, which the cover's windows then find in place; the
    contract bounds a polygon to 10 000 vertices.
    """
    ring = Window.partitionBy(*keys, "part", "ring").orderBy("seq")
    tasks = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work on few bytes: not to be coalesced
    step = vertices.repartition(tasks, *keys).select(*keys, F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(ring).alias("x2"), F.lead("lat").over(ring).alias("y2"))
    return step.where(F.col("x2").isNotNull())


def aoi_cover(edges: DataFrame, keys: Sequence[str] = ("aoi_id",), size: float = 1.0, per_slab: int = 32) -> DataFrame:
    """Pieces ``keys, level, slab, tx, x_from, x_to, inside, edges`` of every polygon.

    ``edges`` comes from :func:`ring_edges`; ``size`` is the width of a tile in
    degrees, a power of two.  ``level`` halves the slabs until about
    ``per_slab`` edges are left in one.  ``edges`` is null for an inside gap
    (open interval), else the cluster's edges (closed interval).
    """
    if math.frexp(size)[0] != 0.5:
        raise ValueError("size must be a power of two")
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    slabs = F.floor(F.max(high).over(whole) / size) - F.floor(F.min(low).over(whole) / size) + 1
    level = F.ceil(F.log2(F.count(F.lit(1)).over(whole) / (slabs * per_slab))).cast("int")
    cut = edges.withColumn("level", F.least(F.greatest(level, F.lit(0)), F.lit(FINEST)))
    cut = cut.withColumn("_h", F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level")))
    cut = cut.withColumn("slab", F.explode(F.sequence(F.floor(low / F.col("_h")).cast("bigint"), F.floor(high / F.col("_h")).cast("bigint"))))
    floor = F.col("slab") * F.col("_h")
    cut = cut.select(
        *keys, "level", "slab", F.least("x1", "x2").alias("xa"), F.greatest("x1", "x2").alias("xb"),
        F.struct("x1", "y1", "x2", "y2").alias("edge"), ((F.col("y1") > floor) != (F.col("y2") > floor)).cast("int").alias("_cross"),
    )
    slab = [*keys, "level", "slab"]
    order = Window.partitionBy(*slab).orderBy("xa", "xb", "edge")
    reach = F.max("xb").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("_new", F.when(reach.isNull() | (F.col("xa") > reach), 1).otherwise(0))
    cut = cut.withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = cut.groupBy(*slab, "_cluster").agg(F.min("xa").alias("xa"), F.max("xb").alias("xb"), F.collect_list("edge").alias("edges"), F.sum("_cross").alias("_cross"))
    along = Window.partitionBy(*slab).orderBy("_cluster")
    after = F.coalesce(F.sum("_cross").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) % 2 == 1
    clusters = clusters.select(*slab, "xa", "xb", "edges", after.alias("inside"), F.lead("xa").over(along).alias("_next"))
    both = F.array(
        F.struct(F.col("xa").alias("x_from"), F.col("xb").alias("x_to"), "inside", "edges"),
        F.struct(F.col("xb").alias("x_from"), F.col("_next").alias("x_to"), "inside", F.lit(None).cast(f"array<{G.EDGE}>").alias("edges")),
    )
    pieces = clusters.select(*slab, F.inline(both)).where(F.col("edges").isNotNull() | (F.col("inside") & F.col("x_to").isNotNull()))
    tile = lambda c: F.floor(F.col(c) / size).cast("bigint")
    return pieces.withColumn("tx", F.explode(F.sequence(tile("x_from"), tile("x_to"))))


def points_in_cover(
    points: DataFrame, cover: DataFrame, size: float = 1.0, lon: str = "lon", lat: str = "lat", rows_per_task: int = 2_000_000, few: int = 6
) -> DataFrame:
    """Pairs of points and polygons that cover them (boundary included): the points' columns and the polygons' keys.

    ``cover`` is a written result of :func:`aoi_cover` with the same ``size``;
    its levels, at most ``FINEST + 1``, are read first.  Gaps and clusters of at
    most ``few`` edges carry them in plain columns, so their pairs are tested in
    compiled code inside the join; only larger clusters keep the fold over an array.
    """
    levels = sorted(r["level"] for r in cover.select("level").distinct().collect())
    x, y = F.col(lon), F.col(lat)
    spots = [F.struct(F.lit(v).alias("level"), F.floor(y / (size / 2.0**v)).cast("bigint").alias("slab")) for v in levels]
    none = F.array().cast("array<struct<level:int,slab:bigint>>")
    placed = points.withColumn("_at", F.explode(F.array(*spots) if spots else none)).withColumns({"level": F.col("_at.level"), "slab": F.col("_at.slab"), "tx": F.floor(x / size).cast("bigint")}).drop("_at")
    own = ["level", "slab", "tx", "x_from", "x_to", "inside"]
    known = F.forall("edges", lambda e: F.nanvl(e["x1"] + e["y1"] + e["x2"] + e["y2"], F.lit(None).cast("double")).isNotNull())
    plain = F.coalesce(F.col("edges").isNull() | ((F.size("edges") <= few) & known), F.lit(False))

    def met(pieces: DataFrame) -> DataFrame:
        return salted_join(placed, pieces, ["level", "slab", "tx"], F.xxhash64(*points.columns), rows_per_task)

    sides = {f"_{i}_{c}": part for i in range(few) for c, part in G.edge_parts(F.get("edges", F.lit(i))).items()}
    each = [{c.split("_")[2]: F.col(c) for c in sides if c.startswith(f"_{i}_")} for i in range(few)]
    gap = F.col("_gap")
    near = met(cover.where(plain).withColumns(sides).withColumn("_gap", F.col("edges").isNull()).drop("edges"))
    near = near.where((x >= F.col("x_from")) & (x <= F.col("x_to"))).where(~gap | ((x > F.col("x_from")) & (x < F.col("x_to"))))
    near = near.where(gap | G.covers_few(each, x, y, F.col("inside"))).drop(*own, *sides, "_gap")
    far = met(cover.where(~plain)).where(x.between(F.col("x_from"), F.col("x_to")))
    return near.unionByName(far.where(G.covers_beside(F.col("edges"), x, y, F.col("inside"))).drop(*own, "edges"))


def boxes_meeting(
    boxes: DataFrame, edges: DataFrame, cover: DataFrame, box_key: str, keys: Sequence[str] = ("aoi_id",), size: float = 1.0, edge_tile: float = 4.0, few: int = 6
) -> DataFrame:
    """Distinct pairs ``box_key, keys`` of boxes ``w, s, e, n`` and polygons that share a point.

    An edge meets the box, or the box lies inside: then its corner does.
    Polygons of at most ``few`` edges travel as one row and meet blocks of boxes
    (``w <= e``, ``s <= n``) once, so their pairs need no distinct and are not
    exchanged; larger ones, and those with unknown coordinates, are met edge by
    edge, and through the cover.
    """
    keys, bounds = list(keys), ["w", "s", "e", "n"]
    some = boxes.select(box_key, *bounds)
    kept = some.groupBy(box_key).agg(F.min(F.struct(*bounds)).alias("_b"), (F.min(F.struct(*bounds)) == F.max(F.struct(*bounds))).alias("_one"))
    single = kept.where(F.col("_one")).select(box_key, "_b.*")
    several = some.join(kept.where(~F.col("_one")).select(F.col(box_key).alias("_key")), F.col(box_key).eqNullSafe(F.col("_key")), "left_semi")
    edge = F.struct("x1", "y1", "x2", "y2")
    unknown = F.nanvl(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2"), F.lit(None).cast("double")).isNull()
    of = Window.partitionBy(*keys)
    counted = edges.withColumn("_n", F.when(F.max(unknown).over(of), few + 1).otherwise(F.count(F.lit(1)).over(of)))
    around = ("_ew", "_es", "_ee", "_en")
    small = counted.where(F.col("_n") <= few).groupBy(*keys).agg(
        F.collect_list(edge).alias("edges"), F.min(F.least("x1", "x2")).alias("_ew"), F.min(F.least("y1", "y2")).alias("_es"),
        F.max(F.greatest("x1", "x2")).alias("_ee"), F.max(F.greatest("y1", "y2")).alias("_en"),
    )
    names = [{c: f"_{i}_{c}" for c in G.BOX_PARTS} for i in range(few)]
    flat = [v.alias(names[i][c]) for i in range(few) for c, v in G.box_parts(F.get("edges", F.lit(i))).items()]
    small = small.select(*keys, *around, *flat)
    each = [{c: F.col(name) for c, name in one.items()} for one in names]

    def whole(some: DataFrame) -> DataFrame:
        near = blocked_join(some, small, bounds, around, edge_tile)
        return near.where(G.box_intersects_few(each, *map(F.col, bounds))).select(box_key, *keys)

    large = counted.where(F.col("_n") > few).drop("_n")
    of_large = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    sides = {"_ew": F.least("x1", "x2"), "_es": F.least("y1", "y2"), "_ee": F.greatest("x1", "x2"), "_en": F.greatest("y1", "y2")}
    near = box_join(some, large.withColumns(sides), bounds, around, edge_tile, spread=box_key)
    touching = near.where(G.edge_hits_box(edge, *map(F.col, bounds))).select(box_key, *keys)
    within = points_in_cover(some.select(box_key, "w", "s"), cover.join(of_large, same, "left_semi"), size, "w", "s").select(box_key, *keys)
    return whole(single).unionByName(touching.unionByName(within).unionByName(whole(several)).distinct())
