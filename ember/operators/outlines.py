"""Contours of ground cells over any number of chips, without a group per chip.

Cells carry ``gx, gy`` on the grid of their CRS (``gy`` grows northwards) and a
class.  Every step is an aggregate, a join or a window along one grid row:

* a cell gives four directed sides with the cell on the left; the two sides
  between neighbours of one class cancel in an aggregate keyed by the ground
  corner, whichever chip or scene the cells came from;
* at a corner each arriving side gets its successor, turning left where two
  regions only touch, so that contours are those of 4-connected regions;
* rings are found and ordered by list ranking: pointers double until every side
  knows the smallest side of its ring and the way to it;
* a hole belongs to what lies left of its leftmost side; following that to an
  outer ring again takes doubled pointers only.

Side numbers hold 29 bits of each grid coordinate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.session import cut_lineage

_HALF = 1 << 28
#: Steps of directions east, north, west, south.
_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: First corner of the bottom, right, top and left side of a cell, and its place among the cell's corners.
_FIRST = ((0, 0, 3), (1, 0, 2), (1, 1, 1), (0, 1, 0))


def _number(x: Column, y: Column, d: Column) -> Column:
    """One long per directed side: 29 bits of x, 29 of y, 2 of the direction."""
    return F.shiftleft(F.shiftleft(x + _HALF, 29) + (y + _HALF), 2) + d


def border_sides(cells: DataFrame, keys: Sequence[str], cls: str = "cls", corners: Sequence[str] | None = None) -> DataFrame:
    """Directed sides between a region and what is not of its class.

    Returns ``keys, cls, x, y, d`` (first corner and direction) and, when
    ``corners`` names the longitude and latitude columns of the cell's corners
    from the upper left clockwise, ``lon, lat`` of the first corner.
    """
    sides = []
    for d, (dx, dy, corner) in enumerate(_FIRST):
        x, y = F.col("gx") + dx, F.col("gy") + dy
        ex, ey = _STEP[d]
        place = [] if corners is None else [F.col(corners[2 * corner]).alias("lon"), F.col(corners[2 * corner + 1]).alias("lat")]
        low = [F.least(x, x + ex).alias("lx"), F.least(y, y + ey).alias("ly")]
        sides.append(F.struct(*low, F.lit(d % 2).alias("axis"), x.alias("x"), y.alias("y"), F.lit(d).alias("d"), *place))
    rest = ["x", "y", "d"] + ([] if corners is None else ["lon", "lat"])
    every = cells.where(F.col(cls) > 0).select(*keys, F.col(cls).cast("int").alias("cls"), F.inline(F.array(*sides)))
    alone = every.groupBy(*keys, "cls", "lx", "ly", "axis").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in rest])
    return alone.where("_n = 1").select(*keys, "cls", *rest)


def follow(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the side's ``id``, its successor ``next`` and ``bend`` (the ring turns at its first corner)."""
    group = [*keys, "cls"]
    ex = F.element_at(F.array(*[F.lit(a) for a, _ in _STEP]), F.col("d") + 1)
    ey = F.element_at(F.array(*[F.lit(b) for _, b in _STEP]), F.col("d") + 1)
    rest = [c for c in sides.columns if c not in (*group, "x", "y", "d")]
    leaving = F.struct("d", *rest)
    ends = sides.select(*group, F.inline(F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.lit(None).cast("int").alias("into"), leaving.alias("out")),
        F.struct((F.col("x") + ex).alias("x"), (F.col("y") + ey).alias("y"), F.col("d").alias("into"), F.lit(None).cast(f"struct<d:int{''.join(f',{c}:double' for c in rest)}>").alias("out")),
    )))
    # at most two sides arrive at a corner and two leave it
    corner = ends.groupBy(*group, "x", "y").agg(F.collect_list("into").alias("into"), F.collect_list("out").alias("out"))
    pairs = corner.withColumn("i", F.explode("into"))
    left = F.filter("out", lambda o: o["d"] == (F.col("i") + 1) % 4)
    pairs = pairs.withColumn("o", F.when(F.size("out") == 1, F.get("out", 0)).otherwise(F.get(left, 0)))
    back = lambda c, axis: F.col(c) - F.element_at(F.array(*[F.lit(s[axis]) for s in _STEP]), F.col("i") + 1)
    return pairs.select(
        *group, "x", "y", _number(back("x", 0), back("y", 1), F.col("i")).alias("before"), _number(F.col("x"), F.col("y"), F.col("o.d")).alias("id"),
        F.col("o.d").alias("d"), (F.col("i") != F.col("o.d")).alias("bend"), *[F.col(f"o.{c}").alias(c) for c in rest],
    )


def rank_rings(followed: DataFrame, keys: Sequence[str], max_rounds: int = 40) -> DataFrame:
    """Adds ``ring`` (its smallest side) and ``seq`` (steps from that side, in order).

    ``followed`` comes from :func:`follow`.  After round k a side knows the
    smallest of the 2^k sides behind it; when no side learns more, every window
    spans its ring.  Each round is written to the checkpoint folder; only two
    numbers reach the driver.
    """
    group = [*keys, "cls"]
    state = cut_lineage(followed.select(*group, "id", F.col("before").alias("ptr"), F.col("id").alias("ring"), F.lit(0).cast("bigint").alias("steps")))
    for k in range(max_rounds):
        other = state.select(*group, F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("ring").alias("_ring"), F.col("steps").alias("_steps"))
        closer = F.col("_ring") < F.col("ring")
        joined = state.join(other, [*group, "ptr"]).select(
            *group, "id", F.col("_ptr").alias("ptr"), F.least("ring", "_ring").alias("ring"),
            F.when(closer, F.col("_steps") + (1 << k)).otherwise(F.col("steps")).alias("steps"), closer.alias("learnt"),
        )
        state = cut_lineage(joined)
        if not state.agg(F.bool_or("learnt")).first()[0]:
            break
    else:
        raise RuntimeError("a ring is longer than 2^40 sides")
    return followed.join(state.select(*group, "id", "ring", F.col("steps").alias("seq")), [*group, "id"])


def ring_summary(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ring: ``sides``, enclosed cells (``area``, negative for holes), ``hole``, ``closed``."""
    ex = F.element_at(F.array(*[F.lit(a) for a, _ in _STEP]), F.col("d") + 1)
    ey = F.element_at(F.array(*[F.lit(b) for _, b in _STEP]), F.col("d") + 1)
    out = ranked.groupBy(*keys, "cls", "ring").agg(
        F.count(F.lit(1)).alias("sides"),
        F.sum(F.col("x") * ey - F.col("y") * ex).alias("_twice"),
        F.max("seq").alias("_last"),
        F.count_if(F.col("bend")).alias("bends"),
        F.sum(ex).alias("_ex"),
        F.sum(ey).alias("_ey"),
    )
    closed = (F.col("_ex") == 0) & (F.col("_ey") == 0) & (F.col("_last") == F.col("sides") - 1)
    return out.select(*keys, "cls", "ring", "sides", "bends", (F.col("_twice") / 2).cast("bigint").alias("area"), (F.col("_twice") < 0).alias("hole"), closed.alias("closed"))


def owners(ranked: DataFrame, rings: DataFrame, keys: Sequence[str], max_rounds: int = 40) -> DataFrame:
    """``keys, cls, ring, outer``: the outer ring of the region that each ring bounds."""
    group = [*keys, "cls"]
    row = Window.partitionBy(*group, "row").orderBy("x")
    upright = ranked.where("d in (1, 3)").select(*group, "ring", "x", "d", F.when(F.col("d") == 1, F.col("y")).otherwise(F.col("y") - 1).alias("row"))
    # a row's runs begin with a side that goes south and end with one that goes north
    ends = upright.withColumn("_left", F.lag("ring").over(row)).where("d = 1")
    nearest = ends.groupBy(*group, "ring").agg(F.min_by("_left", F.struct("x", "row")).alias("outer"))
    state = cut_lineage(rings.select(*group, "ring", "hole").join(nearest, [*group, "ring"]).select(*group, "ring", F.when(F.col("hole"), F.col("outer")).otherwise(F.col("ring")).alias("outer")))
    for _ in range(max_rounds):
        jump = state.select(*group, F.col("ring").alias("outer"), F.col("outer").alias("_next"))
        moved = state.join(jump, [*group, "outer"]).select(*group, "ring", F.col("_next").alias("outer"), (F.col("_next") != F.col("outer")).alias("moved"))
        state = cut_lineage(moved)
        if not state.agg(F.bool_or("moved")).first()[0]:
            break
    return state.select(*group, "ring", "outer")


def cell_runs(cells: DataFrame, keys: Sequence[str], cls: str = "cls") -> DataFrame:
    """Cells of a class with ``x0``, the first column of their run in their grid row."""
    row = Window.partitionBy(*keys, "cls", "gy").orderBy("gx")
    fires = cells.where(F.col(cls) > 0).withColumn("cls", F.col(cls).cast("int"))
    head = ~F.coalesce(F.lag("gx").over(row) == F.col("gx") - 1, F.lit(False))
    return fires.withColumn("_head", head).withColumn("x0", F.max(F.when(F.col("_head"), F.col("gx"))).over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("_head")


def visible_contours(cells: DataFrame, keys: Sequence[str], corners: Sequence[str] | None = None, area: str = "inside_ha") -> tuple[DataFrame, DataFrame]:
    """Regions of one class and the corners of their rings.

    ``cells``: one row per ground cell with ``keys, gx, gy, cls, scene_id,
    date_pre, date_post`` and hectares.  Regions: ``keys, cls, outer, cells,
    area_ha, rings, holes, sides, closed, date_pre, date_post,
    source_scene_ids``.  Corners: ``keys, cls, outer, ring, hole, seq, x, y``
    and ``lon, lat`` if ``corners`` is given, ordered by ``seq``, region on the
    left; straight stretches have no inner corners.
    """
    group = [*keys, "cls"]
    followed = cut_lineage(follow(border_sides(cells, keys, corners=corners), keys))
    ranked = cut_lineage(rank_rings(followed, keys))
    rings = ring_summary(ranked, keys)
    owner = owners(ranked, rings, keys)
    owned = cut_lineage(rings.join(owner, [*group, "ring"]))

    heads = ranked.where("d = 3").select(*group, F.col("x").alias("x0"), (F.col("y") - 1).alias("gy"), "ring")
    heads = heads.join(owner, [*group, "ring"]).drop("ring")
    runs = cell_runs(cells, keys).groupBy(*group, "gy", "x0").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(area).alias("area_ha"), F.min("date_pre").alias("date_pre"), F.max("date_post").alias("date_post"), F.collect_set("scene_id").alias("_ids")
    )
    regions = runs.join(heads, [*group, "gy", "x0"]).groupBy(*group, "outer").agg(
        F.sum("cells").alias("cells"), F.round(F.sum("area_ha"), 6).alias("area_ha"), F.min("date_pre").alias("date_pre"), F.max("date_post").alias("date_post"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids")))).alias("source_scene_ids"),
    )
    totals = owned.groupBy(*group, "outer").agg(
        F.count(F.lit(1)).alias("rings"), F.count_if("hole").alias("holes"), F.sum("sides").alias("sides"), F.sum("area").alias("enclosed"), F.bool_and("closed").alias("closed")
    )
    points = [c for c in ("x", "y", "lon", "lat") if c in ranked.columns]
    vertices = ranked.where("bend").select(*group, "ring", "seq", *points).join(owned.select(*group, "ring", "outer", "hole"), [*group, "ring"])
    return regions.join(totals, [*group, "outer"]), vertices


def ring_lines(vertices: DataFrame, keys: Sequence[str], points: Sequence[str] = ("lon", "lat")) -> DataFrame:
    """Closed lines, one row per ring: ``keys, cls, outer, ring, hole, line``; a line must fit a row."""
    one = F.array_sort(F.collect_list(F.struct("seq", *points)))
    lines = vertices.groupBy(*keys, "cls", "outer", "ring", "hole").agg(one.alias("_p"))
    line = F.transform("_p", lambda p: F.struct(*[p[c].alias(c) for c in points]))
    return lines.select(*keys, "cls", "outer", "ring", "hole", F.concat(line, F.slice(line, 1, 1)).alias("line"))
