"""Area-and-period analysis of many requests in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import geometry as G
from ember.functions.text import severity_name
from ember.operators import areas as A
from ember.operators import outlines as O
from ember.operators.ranking import cell_winners, dedup_hotspots, hotspot_id, mosaic_latest
from ember.operators.spatial import scene_moment, select_scenes, selectable, sized_join
from ember.session import cut_lineage

CELL = ("epsg", "gx", "gy")
BOUNDS = ("aw", "as", "ae", "an")
#: Where a cell and its scene are both in sight: the common part of their bounds.
SIGHT = ("_sw", "_ss", "_se", "_sn")
#: Most time buckets a period is cut into.
BUCKETS = 4096


def pick_scenes(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """``(request_id, task, scene_id)`` of selected scenes with the AOI bounds."""
    return select_scenes(scenes, requests, columns=("request_id", "task", "scene_id", "aw", "as", "ae", "an"))


def scene_cells(scenes: DataFrame, px: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Pixels of every scene as placed ground cells with their hectares.

    Projection and area are worked out once per scene pixel, however many
    requests look at the scene.
    """
    frame = scenes.select(
        "scene_id", "chip_id", "task", "observed_at", "date_pre", "date_post", "epsg", *A.TRANSFORM, "source_scene_id", "grid_row_offset", "grid_col_offset", *carry
    )
    return A.cell_area(A.place_cells(px.where(F.col("valid")).join(frame, "chip_id")), A.WHOLE).drop(*A.TRANSFORM)


def observations(picks: DataFrame, cells: DataFrame) -> DataFrame:
    """Valid cells each request sees inside the bounds of its AOI.

    Rivals for one ground cell share its location, so dropping what lies
    outside the bounds first does not change any winner.
    """
    xs, ys = [F.col(c) for c in A.CORNERS[0::2]], [F.col(c) for c in A.CORNERS[1::2]]
    inside = (F.least(*xs) <= F.col("ae")) & (F.greatest(*xs) >= F.col("aw")) & (F.least(*ys) <= F.col("an")) & (F.greatest(*ys) >= F.col("as"))
    return cells.join(picks, ["scene_id", "task"]).where(inside).drop("aw", "as", "ae", "an")


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def _asked(requests: DataFrame) -> DataFrame:
    """Distinct requests with their period in microseconds (``_from``, ``_to``; null: open)."""
    keep = [c for c in ("request_id", "task", "start", "end", *BOUNDS, "edges", "only_chip") if c in requests.columns]
    return requests.select(*keep).distinct().withColumns({"_from": _micros(F.col("start")), "_to": _micros(F.col("end"))})


def irregular(asked: DataFrame, scenes: DataFrame) -> DataFrame:
    """``request_id, task`` of requests that cell-first selection does not serve.

    These are bound to one chip, or repeat with other bounds or periods, or see a
    scene id that stands for several scenes: what they see is not decided cell by cell.
    """
    name = ["request_id", "task"]
    several = asked.groupBy(*name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*name)
    if "only_chip" in asked.columns:
        several = several.unionByName(asked.where(F.col("only_chip").isNotNull()).select(*name))
    frames = scenes.select("scene_id", "task", "chip_id", scene_moment().alias("_moment"), "w", "s", "e", "n").distinct()
    twice = cut_lineage(frames.groupBy("scene_id", "task").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("scene_id", "task"))
    if not twice.isEmpty():
        seen = select_scenes(scenes.join(twice, ["scene_id", "task"], "left_semi"), asked.drop("_from", "_to"), columns=name)
        several = several.unionByName(seen)
    return several.distinct()


def _served(requests: DataFrame, scenes: DataFrame, px: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Requests for cell-first selection, and the observations of the others (None if there are none)."""
    asked = _asked(requests)
    others = cut_lineage(irregular(asked, scenes))
    if others.isEmpty():
        return asked, None
    picks = cut_lineage(pick_scenes(asked.join(others, ["request_id", "task"], "left_semi").drop("_from", "_to"), scenes).distinct())
    few = scenes.join(picks.select("scene_id").distinct(), "scene_id", "left_semi")
    return asked.join(others, ["request_id", "task"], "left_anti"), observations(picks, scene_cells(few, px))


def sighted_cells(scenes: DataFrame, px: DataFrame) -> DataFrame:
    """:func:`scene_cells` with the scene's time ``_t`` and the box ``SIGHT``.

    A request sees a cell when the cell and its scene both touch the bounds of
    its AOI.  Per axis that is one comparison with the greater of the lower and
    the lesser of the upper ends, so it is one box test.
    """
    ready = scenes.where(selectable() & F.col("scene_id").isNotNull()).withColumn("_t", _micros(scene_moment()))
    cells = scene_cells(ready, px, ("w", "s", "e", "n", "_t"))
    xs, ys = [F.col(c) for c in A.CORNERS[0::2]], [F.col(c) for c in A.CORNERS[1::2]]
    known = cells.where(" and ".join(f"{c} is not null" for c in ("w", "s", "e", "n", "x0", "y0")))
    ends = (F.greatest(F.least(*xs), F.col("w")), F.greatest(F.least(*ys), F.col("s")), F.least(F.greatest(*xs), F.col("e")), F.least(F.greatest(*ys), F.col("n")))
    return known.withColumns(dict(zip(SIGHT, ends))).drop("w", "s", "e", "n")


def _finest(side: float | None) -> int:
    """Tiles not below a sixteenth of a scene, so that a cell touches few of them."""
    return max(-20, math.floor(math.log2(side / 16))) if side and math.isfinite(side) else 0


def _side() -> Column:
    return F.avg(F.greatest(F.abs(F.col("e") - F.col("w")), F.abs(F.col("n") - F.col("s"))))


def newest_observations(requests: DataFrame, scenes: DataFrame, px: DataFrame) -> DataFrame:
    """Per request and ground cell the newest of the :func:`observations` in sight.

    Rivals for a ground cell are met before any request is: an observation reigns
    from its own time until the next one of the same place, and a request meets the
    one that reigns at the end of its period.  So a request's rows are its ground
    cells, however many scenes look at them.  Places are told apart by their
    coordinates too; few ground cells have more than one.
    """
    scenes, requests = cut_lineage(scenes), cut_lineage(requests)
    columns = ["request_id", "task", "scene_id", "date_pre", "date_post", *CELL, *A.CORNERS, "lon", "lat", A.WHOLE, "cls", "valid"]
    asked, others = _served(requests, scenes, px)
    ready = scenes.where(selectable())
    span = ready.select(_micros(scene_moment()).alias("_t"), "w", "s", "e", "n").agg(
        F.min("_t").alias("low"), F.max("_t").alias("high"), F.count(F.lit(1)).alias("scenes"), _side().alias("side")
    ).first()
    low, high = span["low"] or 0, (span["high"] or 0) + 1
    tile = span["side"] or 1.0
    places = ready.agg(F.approx_count_distinct(F.struct("task", F.floor(F.col("w") / tile), F.floor(F.col("s") / tile)))).first()[0]
    width = -(-(high - low) // min(BUCKETS, max(1, span["scenes"] // max(1, places))))
    bucket = lambda t: F.floor((t - low) / width).cast("int")

    wanted = asked.withColumn("_to", F.least(F.coalesce("_to", F.lit(high)), F.lit(high))).where((F.col("_to") > low) & (F.col("_from").isNull() | (F.col("_from") < high)))
    wanted = wanted.withColumn("_bucket", bucket(F.col("_to") - 1)).select("request_id", "task", *BOUNDS, "_from", "_to", "_bucket")
    place = ["task", *CELL, *SIGHT, *A.CORNERS, "lon", "lat", A.WHOLE]
    later = Window.partitionBy(*place).orderBy("_t", F.desc("scene_id"))
    cells = sighted_cells(scenes, px).select(*place, "scene_id", "date_pre", "date_post", "cls", "valid", "_t")
    reigns = cells.withColumn("_until", F.coalesce(F.lead("_t").over(later), F.lit(high))).where("_until > _t")
    dealt = reigns.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_t")), bucket(F.col("_until") - 1))))
    dealt = cut_lineage(dealt.join(wanted.select("task", "_bucket").distinct(), ["task", "_bucket"], "left_semi"))
    pairs = sized_join(dealt, wanted, SIGHT, BOUNDS, _finest(span["side"]), ("task", "_bucket"))
    newest = pairs.where("_t < _to and _to <= _until and (_from is null or _t >= _from)").select(*columns)
    return newest if others is None else newest.unionByName(others.select(*columns))


def seen_hotspots(requests: DataFrame, scenes: DataFrame, px: DataFrame, aoi: DataFrame, height: Column, width: Column) -> DataFrame:
    """:func:`hotspots` of every request, cells first.

    Rivals for a cell have one time, so they are decided before any request is
    met.  Only cells whose rivals are not all in sight of the same bounds are
    decided again per request; of these, few have fires.
    """
    scenes = cut_lineage(scenes.where("task = 'af'"))
    asked, others = _served(cut_lineage(requests.where("task = 'af'")), scenes, px)
    cell = ["shared_grid", "cell_owner", "cell_row", "cell_col"]
    rivals = sighted_cells(scenes, px).withColumn("cls", F.col("cls").cast("int"))
    won = cell_winners(rivals, height, width, ("lon", "lat", "score", "_t"), SIGHT)
    all_of = Window.partitionBy(*cell)
    won = won.withColumns({"_n": F.count(F.lit(1)).over(all_of), "_fire": F.max((F.col("cls") == 1).cast("int")).over(all_of)}).where("_fire = 1").drop("_fire", "rw", "cl")
    won = cut_lineage(won)
    finest = _finest(scenes.agg(_side()).first()[0])
    period = "(_from is null or _t >= _from) and (_to is null or _t < _to)"
    inside = G.covers(F.col("edges"), F.col("lon"), F.col("lat"))
    score = F.when(~F.isnan("score") & (F.abs(F.col("score")) != float("inf")), F.col("score"))
    columns = ["request_id", "scene_id", "observed_at", hotspot_id(F.col("cell_owner"), F.col("cell_row"), F.col("cell_col")).alias("hotspot_id"), "lon", "lat", score.alias("score")]
    shapes, bounds = aoi.select("request_id", "edges"), asked.select("request_id", *BOUNDS, "_from", "_to")
    found = sized_join(won.where("_n = 1"), bounds.join(shapes, "request_id"), SIGHT, BOUNDS, finest).where(period).where(inside).select(*columns)
    split = won.where("_n > 1")
    if not split.isEmpty():
        met = sized_join(split, bounds, SIGHT, BOUNDS, finest).where(period)
        payload = F.struct("scene_id", "observed_at", "lon", "lat", "score", "cls")
        best = met.groupBy("request_id", *cell).agg(F.min_by(payload, F.struct("_p", "scene_id")).alias("_w")).select("request_id", *cell, "_w.*").where("cls = 1")
        found = found.unionByName(best.join(shapes, "request_id").where(inside).select(*columns))
    return found if others is None else found.unionByName(hotspots(others, aoi, height, width))


def hotspots(obs: DataFrame, aoi: DataFrame, height: Column, width: Column) -> DataFrame:
    """De-duplicated fire points inside the AOI, per request.

    Cell owners are prefixed with the request so that one aggregation serves
    all requests.
    """
    af = obs.where(F.col("task") == "af").withColumn("cls", F.col("cls").cast("int"))
    keyed = af.withColumns(
        {
            "scene_id": F.concat_ws("\u0001", F.col("request_id").cast("string"), "scene_id"),
            "source_scene_id": F.when(F.col("source_scene_id").isNotNull(), F.concat_ws("\u0001", F.col("request_id").cast("string"), "source_scene_id")),
        }
    )
    won = dedup_hotspots(keyed, height, width, ("request_id", "lon", "lat", "score"))
    inside = won.join(aoi.select("request_id", "edges"), "request_id").where(G.covers(F.col("edges"), F.col("lon"), F.col("lat")))
    plain = lambda c: F.element_at(F.split(c, "\u0001"), -1)
    score = F.when(~F.isnan("score") & (F.abs(F.col("score")) != float("inf")), F.col("score"))
    return inside.select(
        "request_id",
        plain(F.col("scene_id")).alias("scene_id"),
        "observed_at",
        hotspot_id(plain(F.col("cell_owner")), F.col("cell_row"), F.col("cell_col")).alias("hotspot_id"),
        "lon",
        "lat",
        score.alias("score"),
    )


def burned_cells(obs: DataFrame, aoi: DataFrame) -> DataFrame:
    """Visible class of every ground cell (newest wins) with hectares inside."""
    bs = obs.where(F.col("task") == "bs")
    newest = mosaic_latest(bs, ("request_id", *CELL), ("date_pre", *A.CORNERS, "lon", "lat", A.WHOLE))
    return A.clip_cells(newest.join(aoi.select("request_id", "edges", "rings"), "request_id")).drop("edges", "rings")


def burn_contours(burned: DataFrame, corners: Sequence[str] | None = A.CORNERS) -> tuple[DataFrame, DataFrame]:
    """Regions of the visible burn classes and the corners of their rings.

    ``burned`` comes from :func:`burned_cells`.  Chips and scenes leave no
    seams; hectares are those inside the AOI, rings run along whole cells.
    """
    return O.visible_contours(burned.where("cls > 0"), ("request_id", "epsg"), corners=corners)


def contour_features(regions: DataFrame, vertices: DataFrame) -> DataFrame:
    """One feature per region: properties and closed longitude/latitude rings, the outer one first."""
    lines = O.ring_lines(vertices, ("request_id", "epsg"))
    rings = lines.groupBy("request_id", "epsg", "cls", "outer").agg(F.array_sort(F.collect_list(F.struct("hole", "ring", "line"))).alias("rings"))
    number = F.concat_ws(":", F.element_at("source_scene_ids", 1), F.col("cls").cast("string"), F.hex("outer"))
    return regions.join(rings.withColumnRenamed("rings", "_rings"), ["request_id", "epsg", "cls", "outer"]).select(
        "request_id", number.alias("contour_id"), F.col("cls").alias("class_id"), severity_name(F.col("cls")).alias("severity"), "area_ha",
        "date_pre", "date_post", "source_scene_ids", F.transform("_rings", lambda r: r["line"]).alias("rings"),
    )


def observed_cells(obs: DataFrame, aoi: DataFrame) -> DataFrame:
    """Distinct valid ground cells per request and task with hectares inside."""
    valid = obs.where(F.col("valid"))
    keep = [*A.CORNERS, "lon", "lat", A.WHOLE]
    cells = valid.groupBy("request_id", "task", *CELL).agg(*[F.min(c).alias(c) for c in keep])
    return A.clip_cells(cells.join(aoi.select("request_id", "edges", "rings"), "request_id")).drop("edges", "rings")


def analyse(requests: DataFrame, scenes: DataFrame, px: DataFrame, aoi: DataFrame, height: Column, width: Column) -> DataFrame:
    """One report row per request and task.

    ``requests`` as for ``select_scenes`` (one row per requested task); ``aoi``:
    request_id, edges, rings, aoi_ha.
    """
    # several products read both: write them once
    requests, scenes = cut_lineage(requests), cut_lineage(scenes)
    chosen = select_scenes(scenes, requests, columns=("request_id", "task")).groupBy("request_id", "task").agg(F.count(F.lit(1)).alias("observation_count"))
    wanted_scenes = cut_lineage(scenes.join(pick_scenes(requests, scenes).select("scene_id").distinct(), "scene_id", "left_semi"))
    newest = newest_observations(requests, wanted_scenes, px)
    spots = seen_hotspots(requests, wanted_scenes, px, aoi, height, width).groupBy("request_id").agg(F.count(F.lit(1)).alias("hotspot_count")).withColumn("task", F.lit("af"))
    # the contours are counted, not drawn: corners stay behind
    fires = cut_lineage(burned_cells(newest, aoi).where(F.col("cls") > 0).drop(*A.CORNERS, "lon", "lat"))
    burned = A.severity_areas(fires, ["request_id"]).withColumn("task", F.lit("bs"))
    regions, _ = burn_contours(fires, None)
    shapes = regions.groupBy("request_id").agg(F.count(F.lit(1)).alias("contour_count"), F.sum("rings").alias("ring_count")).withColumn("task", F.lit("bs"))
    wanted = (
        requests.select("request_id", "task")
        .join(aoi.select("request_id", "aoi_ha"), "request_id")
        .join(chosen, ["request_id", "task"], "left")
        .withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    )
    cov = A.coverage(observed_cells(newest, aoi), wanted, ["request_id", "task"])
    full = cov.join(spots, ["request_id", "task"], "left").join(burned, ["request_id", "task"], "left").join(shapes, ["request_id", "task"], "left")
    is_af = F.col("task") == "af"
    filled = full.withColumns(
        {
            "hotspot_count": F.when(is_af, F.coalesce("hotspot_count", F.lit(0))),
            **{m: F.when(~is_af, F.coalesce(F.col(m), F.lit(0.0))) for m in ("area_1", "area_2", "area_3", "burn_area_ha")},
            **{m: F.when(~is_af, F.coalesce(F.col(m), F.lit(0))) for m in ("contour_count", "ring_count")},
        }
    )
    return A.module_status(filled, ["hotspot_count", "area_1", "area_2", "area_3", "burn_area_ha", "contour_count", "ring_count"])
