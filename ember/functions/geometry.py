"""Planar predicates on lon/lat polygons held as an array of edges.

A polygon (with holes and parts) is one ``array<struct<x1,y1,x2,y2>>``; the
contract bounds it to 10 000 vertices, so testing a point is a fold over one
small array and needs no join of points with edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def valid_bbox(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Finite, ordered and inside WGS84 (NaN and NULL fail)."""
    ok = F.lit(True)
    for value in (w, s, e, n):
        ok = ok & value.isNotNull() & ~F.isnan(value)
    inside = (w >= -180) & (w < e) & (e <= 180) & (s >= -90) & (s < n) & (n <= 90)
    return F.coalesce(ok & inside, F.lit(False))


def bbox_ring(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Closed counter-clockwise ring from the south-west corner."""
    corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])


def bbox_edges(w: Column, s: Column, e: Column, n: Column) -> Column:
    corners = [(w, s), (e, s), (e, n), (w, n)]
    pairs = zip(corners, corners[1:] + corners[:1])
    return F.array(
        *[
            F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
            for a, b in pairs
        ]
    )


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the signed area of triangle a, b, p."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def on_segment(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """p lies in the bounding box of ab (use together with ``cross == 0``)."""
    return (
        (F.least(ax, bx) <= px) & (px <= F.greatest(ax, bx)) & (F.least(ay, by) <= py) & (py <= F.greatest(ay, by))
    )


def segments_touch(a, b, c, d) -> Column:
    """Segments ab and cd cross or touch; points are (x, y) Column pairs."""
    c1, c2 = cross(*a, *b, *c), cross(*a, *b, *d)
    c3, c4 = cross(*c, *d, *a), cross(*c, *d, *b)
    proper = (((c1 > 0) & (c2 < 0)) | ((c1 < 0) & (c2 > 0))) & (((c3 > 0) & (c4 < 0)) | ((c3 < 0) & (c4 > 0)))
    return (
        proper
        | ((c1 == 0) & on_segment(*a, *b, *c))
        | ((c2 == 0) & on_segment(*a, *b, *d))
        | ((c3 == 0) & on_segment(*c, *d, *a))
        | ((c4 == 0) & on_segment(*c, *d, *b))
    )


def covers(edges: Column, x: Column, y: Column, beyond: Column | None = None) -> Column:
    """Point inside or on the boundary (even-odd rule over all rings)."""

    def touches(e: Column) -> Column:
        return (cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y) == 0) & on_segment(
            e["x1"], e["y1"], e["x2"], e["y2"], x, y
        )

    def crossing(acc: Column, e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return acc + F.when(straddles & (x < at), 1).otherwise(0)

    odd = F.aggregate(edges, F.lit(0), crossing) % 2 == 1
    if beyond is not None:
        odd = odd != beyond
    return odd | F.exists(edges, touches)


def edge_parts(e: Column) -> dict[str, Column]:
    """What :func:`covers_few` reads of an edge; all NaN where there is none."""
    x1, y1, x2, y2 = (F.coalesce(e[c], F.lit(float("nan"))) for c in ("x1", "y1", "x2", "y2"))
    return {"x1": x1, "y1": y1, "dx": x2 - x1, "dy": y2 - y1, "xa": F.least(x1, x2), "xb": F.greatest(x1, x2), "ya": F.least(y1, y2), "yb": F.greatest(y1, y2)}


def covers_few(edges: Sequence[Mapping[str, Column]], x: Column, y: Column, beyond: Column) -> Column:
    """:func:`covers_beside` for a few edges in plain columns (``edge_parts``), written out edge by edge.

    Functions over arrays are interpreted; this is compiled, which pays where
    very many pairs are tested.  The arithmetic is that of the fold; the parts
    keep the code of some eight edges below the 8000 bytes that the JVM compiles.
    """
    odd, hit = beyond, F.lit(False)
    for e in edges:
        rise = e["dx"] * (y - e["y1"])
        beside = (e["ya"] <= y) & (y <= e["yb"])
        odd = odd != F.when(beside & (y < e["yb"]), x < rise / e["dy"] + e["x1"]).otherwise(False)
        hit = hit | (beside & (e["xa"] <= x) & (x <= e["xb"]) & (rise - e["dy"] * (x - e["x1"]) == 0))
    return odd | hit


def covers_beside(edges: Column, x: Column, y: Column, beyond: Column) -> Column:
    """:func:`covers` from the edges near a point; ``beyond`` tells whether what lies to their right is inside."""
    return covers(edges, x, y, beyond)


def edge_hits_box(e: Column, w: Column, s: Column, east: Column, n: Column) -> Column:
    """Edge shares at least one point with a closed box.

    Separating axes: the two box axes, and the edge's own normal - the box
    misses the edge exactly when all four corners lie strictly on one side.
    """
    overlap = (
        (F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= w) & (F.least(e["y1"], e["y2"]) <= n) & (F.greatest(e["y1"], e["y2"]) >= s)
    )
    sides = [cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y) for x, y in ((w, s), (east, s), (east, n), (w, n))]
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def box_intersects(edges: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Closed box and polygon share a point."""
    return F.exists(edges, lambda edge: edge_hits_box(edge, w, s, e, n)) | covers(edges, w, s)


BOX_PARTS = ("x1", "y1", "x2", "y2", "dx", "dy")


def box_parts(e: Column) -> dict[str, Column]:
    """What :func:`box_intersects_few` reads of an edge; all NaN where there is none."""
    x1, y1, x2, y2 = (F.coalesce(e[c], F.lit(float("nan"))) for c in BOX_PARTS[:4])
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "dx": x2 - x1, "dy": y2 - y1}


def box_intersects_few(edges: Sequence[Mapping[str, Column]], w: Column, s: Column, e: Column, n: Column) -> Column:
    """:func:`box_intersects` for a few edges in plain columns (``box_parts``), written out edge by edge.

    Functions over arrays are interpreted; this is compiled, which pays where
    very many pairs are tested.  Rounded sums and products keep the order of
    their operands, so the least of the four corners' sides comes from the least
    and greatest terms; this keeps the code of some seven edges below the 8000
    bytes that the JVM compiles.
    """
    hit, odd = F.lit(False), F.lit(False)
    for edge in edges:
        x1, y1, x2, y2, dx, dy = (edge[c] for c in BOX_PARTS)
        low, high = (F.when(dx >= 0, a).otherwise(b) for a, b in ((s, n), (n, s)))
        left, right = (F.when(dy >= 0, a).otherwise(b) for a, b in ((w, e), (e, w)))
        overlap = ((x1 <= e) | (x2 <= e)) & ((x1 >= w) | (x2 >= w)) & ((y1 <= n) | (y2 <= n)) & ((y1 >= s) | (y2 >= s))
        hit = hit | (overlap & (dx * (low - y1) - dy * (right - x1) <= 0) & (dx * (high - y1) - dy * (left - x1) >= 0))
        odd = odd != (((y1 > s) != (y2 > s)) & (w < dx * (s - y1) / dy + x1))
    return hit | odd
