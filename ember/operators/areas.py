"""Cells on the ground: clipping, hectares, coverage and status."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ember.functions import geometry as G
from ember.functions import projection as P

TRANSFORM = ("ga", "gb", "gc", "gd", "ge", "gf")
WHOLE = "cell_ha"
CORNERS = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")


def place_cells(px: DataFrame) -> DataFrame:
    """Add corner and centre coordinates and the global cell key.

    ``px`` carries the affine transform ``ga..gf`` and ``epsg``.  Grids of one
    CRS and pixel size are aligned, so ``(epsg, gx, gy)`` names a ground cell
    exactly across scenes.
    """
    t = [F.col(c) for c in TRANSFORM]
    points = {"c": P.pixel_xy(F.col("rw"), F.col("cl"), t)}
    for i, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))):
        points[f"k{i}"] = P.pixel_xy(F.col("rw") + dr, F.col("cl") + dc, t, centre=False)
    x, y = points["c"]
    cells = px.withColumns({"gx": F.floor(x / F.abs(F.col("ga"))).cast("bigint"), "gy": F.floor(y / F.abs(F.col("ge"))).cast("bigint")})
    placed = P.with_lonlat(cells, points, digits=7)
    names = {"c_lon": "lon", "c_lat": "lat"} | {f"k{i}_{a}": f"{b}{i}" for i in range(4) for a, b in (("lon", "x"), ("lat", "y"))}
    return placed.withColumnsRenamed(names)


def cell_area(cells: DataFrame, out: str = "cell_ha") -> DataFrame:
    points = [(F.col(CORNERS[i]), F.col(CORNERS[i + 1])) for i in range(0, 8, 2)]
    return cells.withColumn(out, P.cell_area_ha(points))


def planar_area(px: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Control area ``|a e - b d|`` times pixel count, in map units squared."""
    one = F.abs(F.col("ga") * F.col("ge") - F.col("gb") * F.col("gd"))
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), F.sum(one).alias("area"))


def _clip(ring: list, quad: list) -> list:
    """Clip any ring to a convex quad, half-plane by half-plane.

    Plain floats: the rings are short, and small arrays would cost more than
    they save.
    """
    following = quad[1:] + quad[:1]
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(quad, following)) < 0:
        quad = quad[::-1]
        following = quad[1:] + quad[:1]
    for (ax, ay), (bx, by) in zip(quad, following):
        if not ring:
            return ring
        dx, dy = bx - ax, by - ay
        kept = []
        px, py = ring[-1]
        sp = dx * (py - ay) - dy * (px - ax)
        for qx, qy in ring:
            sq = dx * (qy - ay) - dy * (qx - ax)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                kept.append((px + (qx - px) * t, py + (qy - py) * t))
            if sq >= 0:
                kept.append((qx, qy))
            px, py, sp = qx, qy, sq
        ring = kept
    return ring


def _ha(ring: list) -> float:
    """Equal-area hectares of a lon/lat ring."""
    if len(ring) < 3:
        return 0.0
    points = []
    for lon, lat in ring:
        s = math.sin(math.radians(lat))
        es = P.E * s
        q = (1 - P.E2) * (s / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * P.E))
        points.append((P.A * P.CEA_K0 * math.radians(lon), P.A / (2 * P.CEA_K0) * q))
    x0, y0 = points[0]
    total = 0.0
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        total += (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
    return abs(total) / 2 / 10000


@F.pandas_udf(T.DoubleType())
def clipped_ha(quads: pd.Series, rings: pd.Series) -> pd.Series:
    """Hectares of a convex cell inside a polygon: outer rings minus holes."""
    out = []
    for quad, polygon in zip(quads, rings):
        if quad is None:
            out.append(0.0)
            continue
        flat = quad.tolist()
        corners = list(zip(flat[0::2], flat[1::2]))
        total = 0.0
        for ring in polygon:
            points = list(zip(ring["lons"].tolist(), ring["lats"].tolist()))
            if len(points) > 1 and points[0] == points[-1]:
                points.pop()
            total += (-1 if ring["hole"] else 1) * _ha(_clip(points, corners))
        out.append(max(0.0, total))
    return pd.Series(out, dtype="float64")


def polygon_rings(vertices: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Ordered rings per AOI for clipping: ``rings array<struct<hole,lons,lats>>``.

    ``ring = 0`` is a part's outer ring, the others are holes.
    """
    ordered = vertices.groupBy(*keys, "part", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("_v"))
    one = F.struct(
        (F.col("ring") > 0).alias("hole"),
        F.transform("_v", lambda v: v["lon"]).alias("lons"),
        F.transform("_v", lambda v: v["lat"]).alias("lats"),
    )
    return ordered.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("rings"))


def bbox_aoi(df: DataFrame, w: str = "aw", s: str = "as", e: str = "ae", n: str = "an") -> DataFrame:
    """Add ``edges`` and ``rings`` of a rectangular AOI."""
    cw, cs, ce, cn = (F.col(c) for c in (w, s, e, n))
    ring = F.struct(F.lit(False).alias("hole"), F.array(cw, ce, ce, cw, cw).alias("lons"), F.array(cs, cs, cn, cn, cs).alias("lats"))
    return df.withColumns({"edges": G.bbox_edges(cw, cs, ce, cn), "rings": F.array(ring)})


def clip_cells(cells: DataFrame, out: str = "inside_ha") -> DataFrame:
    """Hectares of each cell inside its AOI (``edges``, ``rings`` on the row).

    Cells no AOI edge comes near are whole or dropped in generated code; only
    boundary cells carry their corners and rings through Arrow for exact
    clipping, all others send NULLs.  One pass, nothing upstream runs twice.
    """
    xs, ys = [F.col(CORNERS[i]) for i in (0, 2, 4, 6)], [F.col(CORNERS[i]) for i in (1, 3, 5, 7)]
    box = cells.withColumns({"_w": F.least(*xs), "_e": F.greatest(*xs), "_s": F.least(*ys), "_n": F.greatest(*ys)})
    near = F.exists("edges", lambda edge: G.edge_hits_box(edge, F.col("_w"), F.col("_s"), F.col("_e"), F.col("_n")))
    tagged = box.withColumn("_near", near)
    sent = tagged.withColumns({"_quad": F.when(F.col("_near"), F.array(*[F.col(c) for c in CORNERS])), "_rings": F.when(F.col("_near"), F.col("rings"))})
    clipped = sent.withColumn("_clip", clipped_ha(F.col("_quad"), F.col("_rings")))
    if WHOLE not in cells.columns:
        clipped = cell_area(clipped, WHOLE)
    inside = F.when(G.covers(F.col("edges"), F.col("lon"), F.col("lat")), F.col(WHOLE)).otherwise(0.0)
    area = F.when(F.col("_near"), F.col("_clip")).otherwise(inside)
    helpers = ["_w", "_e", "_s", "_n", "_near", "_quad", "_rings", "_clip", WHOLE]
    return clipped.withColumn(out, area).where(F.col(out) > 0).drop(*helpers)


def severity_areas(cells: DataFrame, keys: Sequence[str], area: str = "inside_ha") -> DataFrame:
    """Hectares per severity class and the burn total as their sum."""
    per = cells.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("cls") == c, F.col(area)).otherwise(0.0)).alias(f"area_{c}") for c in (1, 2, 3)]
    )
    return per.withColumn("burn_area_ha", F.col("area_1") + F.col("area_2") + F.col("area_3"))


def priority_class(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest severity where classes overlap on one cell."""
    return cells.groupBy(*keys).agg(F.max("cls").alias("cls"))


def union_cells(*parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct cells of several coverages."""
    out = parts[0].select(*keys)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys))
    return out.distinct()


def coverage(observed: DataFrame, aoi: DataFrame, keys: Sequence[str], area: str = "inside_ha") -> DataFrame:
    """Observed, unobserved hectares and fraction per request and task.

    ``observed`` has one row per distinct valid ground cell; ``aoi`` has
    ``keys, aoi_ha, observation_count``.
    """
    sums = observed.groupBy(*keys).agg(F.sum(area).alias("_o"))
    joined = aoi.join(sums, list(keys), "left")
    seen = F.least(F.coalesce(F.col("_o"), F.lit(0.0)), F.col("aoi_ha"))
    return joined.select(
        *keys,
        "aoi_ha",
        "observation_count",
        seen.alias("observed_area_ha"),
        F.greatest(F.lit(0.0), F.col("aoi_ha") - seen).alias("unobserved_area_ha"),
        F.when(F.col("aoi_ha") > 0, seen / F.col("aoi_ha")).otherwise(0.0).alias("coverage_fraction"),
    )


def status_of(observed: Column, fraction: Column) -> Column:
    return F.when(observed == 0, "no_data").when(fraction >= 1 - 1e-8, "complete").otherwise("partial")


def module_status(cov: DataFrame, measures: Sequence[str] = ()) -> DataFrame:
    """Adds ``data_status``; measures of modules without data become NULL."""
    out = cov.withColumn("data_status", status_of(F.col("observed_area_ha"), F.col("coverage_fraction")))
    return out.withColumns({m: F.when(F.col("data_status") != "no_data", F.col(m)) for m in measures})


def overall_status(modules: DataFrame, key: str = "request_id") -> DataFrame:
    """Roll module statuses up to one per request."""
    flags = modules.groupBy(key).agg(
        F.min((F.col("data_status") == "no_data").cast("int")).alias("_none"),
        F.min((F.col("data_status") == "complete").cast("int")).alias("_all"),
    )
    return flags.select(key, F.when(F.col("_none") == 1, "no_data").when(F.col("_all") == 1, "complete").otherwise("partial").alias("data_status"))


def normalise_result(df: DataFrame) -> DataFrame:
    """Default statuses and blank measures of modules without data.

    ``df``: request_id, status, af_status, bs_status, hotspot_count,
    burn_area_ha, area_1..3 (any may be NULL).
    """
    known = ("complete", "partial", "no_data", "model_unavailable")
    raw = F.col("status")
    overall = F.when(raw.isin("unavailable", "model_unavailable", "MODEL_NOT_READY"), "model_unavailable").when(raw.isin(*known), raw).otherwise("complete")

    def module(name: str, present: Column) -> Column:
        own = F.col(name)
        return (
            F.when(F.col("status") == "model_unavailable", "model_unavailable")
            .when(own.isin(*known), own)
            .when(present, F.col("status"))
            .otherwise("no_data")
        )

    def shown(measure: str, status: str) -> Column:
        value = F.col(measure).cast("double")
        ok = ~F.isnan(value) & (F.abs(value) != float("inf")) & ~F.col(status).isin("no_data", "model_unavailable")
        return F.when(ok, value)

    base = df.withColumn("status", overall)
    base = base.withColumns(
        {
            "af_status": module("af_status", F.col("has_af")),
            "bs_status": module("bs_status", F.col("has_bs")),
        }
    )
    return base.withColumns(
        {
            "hotspot_count": shown("hotspot_count", "af_status"),
            **{m: shown(m, "bs_status") for m in ("burn_area_ha", "area_1", "area_2", "area_3")},
        }
    )


def catalog_summary(scenes: DataFrame, presets: DataFrame) -> DataFrame:
    """Per data set: tasks, scene count, first scene date, last date or preset end."""
    dates = F.array_compact(F.array("observed_at", "date_pre", "date_post"))
    per_scene = scenes.withColumn("_d", dates)
    summary = per_scene.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("scene_count"),
        F.array_sort(F.collect_set(F.when(F.col("task").isin("af", "bs"), F.col("task")))).alias("tasks"),
        F.min(F.array_min("_d")).alias("first_date"),
        F.max(F.array_max("_d")).alias("_last"),
    )
    ends = presets.groupBy("dataset_id").agg(F.max("period_end").alias("_preset"))
    return summary.join(ends, "dataset_id", "left").select(
        "dataset_id", "scene_count", "tasks", "first_date", F.greatest("_last", "_preset").alias("last_date")
    )


def envelope(vertices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return vertices.groupBy(*keys).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
