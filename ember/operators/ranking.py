"""Winners: de-duplication, mosaics, top-k and searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.session import cut_lineage


def hotspot_cell(px: DataFrame) -> DataFrame:
    """Identify the ground cell of a fire candidate.

    With a declared shared grid the cell is (source scene, time, global row,
    global column); otherwise it is local to the scene.
    """
    shared = F.col("source_scene_id").isNotNull() & F.col("grid_row_offset").isNotNull() & F.col("grid_col_offset").isNotNull()
    stamp = F.col("observed_at").cast("string")
    return px.withColumns(
        {
            "shared_grid": shared,
            "cell_owner": F.when(shared, F.concat_ws(":", "source_scene_id", stamp)).otherwise(F.col("scene_id")),
            "cell_row": F.when(shared, F.col("rw") + F.col("grid_row_offset")).otherwise(F.col("rw")),
            "cell_col": F.when(shared, F.col("cl") + F.col("grid_col_offset")).otherwise(F.col("cl")),
        }
    )


def cell_winners(px: DataFrame, height: Column, width: Column, carry: Sequence[str] = ("score",), keys: Sequence[str] = ()) -> DataFrame:
    """The winning observation of every cell (apart by ``keys``), fire or not, with its rank ``_p``.

    The winner is the pixel farthest from its chip's edge, then the smallest
    scene id.  Only valid pixels compete, and background competes only on a
    shared grid.  A minimum over a struct combines map-side, so a cell seen by
    very many scenes does not gather in one place.
    """
    context = F.least(F.col("rw") + 1, F.col("cl") + 1, height - F.col("rw"), width - F.col("cl"))
    cells = hotspot_cell(px.where(F.col("valid"))).where(F.col("shared_grid") | (F.col("cls") == 1)).withColumn("_p", -context)
    rank = F.struct(F.col("_p").alias("p"), F.col("scene_id"))
    payload = F.struct("scene_id", "observed_at", "rw", "cl", "cls", "_p", *carry)
    winners = cells.groupBy("shared_grid", "cell_owner", "cell_row", "cell_col", *keys).agg(F.min_by(payload, rank).alias("_w"))
    return winners.select("shared_grid", "cell_owner", "cell_row", "cell_col", *keys, "_w.*")


def dedup_hotspots(px: DataFrame, height: Column, width: Column, carry: Sequence[str] = ("score",)) -> DataFrame:
    """One winning observation per cell (:func:`cell_winners`); only fire winners remain."""
    return cell_winners(px, height, width, carry).where(F.col("cls") == 1).drop("cls", "_p")


def hotspot_id(owner: Column, row: Column, col: Column) -> Column:
    return F.concat_ws(":", owner, row.cast("string"), col.cast("string"))


def mosaic_latest(cells: DataFrame, key: Sequence[str] = ("epsg", "gx", "gy"), carry: Sequence[str] = ()) -> DataFrame:
    """Newest valid observation per global cell, ties to the smallest scene id.

    A later valid background pixel hides older burns.  Aggregates with map-side
    combining; popular cells do not pile up.
    """
    newest = F.struct((-F.unix_micros(F.col("date_post").cast("timestamp"))).alias("t"), F.col("scene_id"))
    payload = F.struct("scene_id", "date_post", "cls", *carry)
    won = cells.where(F.col("valid")).groupBy(*key).agg(F.min_by(payload, newest).alias("_w"))
    return won.select(*key, "_w.*")


def top_chips(meta: DataFrame, k: int = 2) -> DataFrame:
    """Validation chips richest in fire (AF) or in their rarest severity (BS)."""
    richness = F.when(F.col("kind") == "af", F.col("n_fire_px")).otherwise(F.least("sev1_px", "sev2_px", "sev3_px"))
    ranked = meta.where(F.col("split") == "val").withColumn("richness", richness).withColumn(
        "rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("richness"), "chip_id"))
    )
    return ranked.where(F.col("rank") <= k)


#: A search looks back this many times further when a window does not settle it.
FURTHER = 16


def _micros(moment: Column, zoned: bool) -> Column:
    """Microseconds in the order of the times; local times are not shifted by a zone."""
    if zoned:
        return F.unix_micros(moment.cast("timestamp"))
    local = moment.cast("timestamp_ntz")
    minutes = (F.unix_date(local.cast("date")).cast("bigint") * 24 + F.hour(local)) * 60 + F.minute(local)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("bigint")


def _matching(scenes: DataFrame, requests: DataFrame, size: float, keys: Sequence[str], rows_per_task: int) -> DataFrame:
    from ember.operators.spatial import box_join

    return box_join(scenes, requests, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), size, keys=keys, spread="scene_id", rows_per_task=rows_per_task).where(
        (F.col("acquired_at") >= F.col("date_start"))
        & (F.col("acquired_at") < F.date_add(F.col("date_end").cast("date"), 1))
        & (F.col("cloud_percent") <= F.col("cloud_max"))
    )


def _buckets(width: int, request: bool) -> Column:
    """Buckets of ``width`` microseconds: a scene's own one, or the last two of a request's window."""
    if not request:
        return F.array(F.floor(F.col("_t") / width).cast("bigint"))
    last = F.floor((F.col("_high") - 1) / width).cast("bigint")
    return F.sequence(F.greatest(last - 1, F.floor(F.col("_low") / width).cast("bigint")), last)


def search_windows(scenes: DataFrame, requests: DataFrame, size: float, rows_per_task: int) -> tuple[DataFrame, list[int]]:
    """Requests with ``_step``, the shortest of the returned windows that holds all they can return.

    ``scenes`` carry ``_t``; ``requests`` have one row per ``request_id`` and carry
    ``_low, _high``.  A window is long enough when it holds more matches than the
    request admits, or reaches its first day.  Only counts are exchanged.
    """
    from ember.operators.spatial import tile_boxes

    def tiles(df: DataFrame, name: str, *box: str) -> DataFrame:
        return tile_boxes(df.select(*box), *box, size).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias(name))

    near = tiles(scenes, "_s", "w", "s", "e", "n").join(tiles(requests, "_r", "aw", "as", "ae", "an"), ["tx", "ty"]).agg(F.sum(F.col("_s").cast("double") * F.col("_r"))).first()[0]
    span = scenes.agg(F.min("_t").alias("low"), F.max("_t").alias("high")).first()
    asked = requests.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_high") - F.col("_low")).alias("longest"), F.avg("max_results").alias("limit")).first()
    longest = max(1, asked["longest"] or 1)
    pairs = (near or 0.0) / max(1, asked["n"])
    reach = ((span["high"] or 0) - (span["low"] or 0) + 1) * 8 * ((asked["limit"] or 0) + 1) / max(1.0, pairs)
    widths, done, rest = [int(min(max(reach, 1), longest))], None, requests
    while True:
        width, step = widths[-1], len(widths) - 1
        if width >= longest:
            last = rest.withColumn("_step", F.lit(step))
            return (last if done is None else done.unionByName(last)), widths
        met = _matching(scenes.withColumn("_bucket", F.explode(_buckets(width, False))), rest.withColumn("_bucket", F.explode(_buckets(width, True))), size, ("_bucket",), rows_per_task)
        found = met.groupBy("request_id").agg(F.count(F.lit(1)).alias("_found")).withColumnRenamed("request_id", "_id")
        counted = rest.join(found, F.col("request_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        reached = F.floor((F.col("_high") - 1) / width) - 1 <= F.floor(F.col("_low") / width)
        settled = cut_lineage(counted.withColumn("_settled", reached | (F.coalesce("_found", F.lit(0)) > F.col("max_results"))).drop("_found"))
        now = settled.where("_settled").drop("_settled").withColumn("_step", F.lit(step))
        done = now if done is None else done.unionByName(now)
        rest = settled.where("not _settled").drop("_settled")
        if rest.isEmpty():
            return done, widths
        widths.append(int(min(width * FURTHER, longest)))


def search_scenes(scenes: DataFrame, requests: DataFrame, size: float = 5.0, rows_per_task: int = 2_000_000) -> DataFrame:
    """Newest scenes per request: bounds meet, inclusive days, cloud limit.

    ``scenes``: scene_id, acquired_at, cloud_percent, w,s,e,n; ``requests``:
    request_id, date_start, date_end, cloud_max, max_results, aw,as,ae,an.
    ``truncated`` tells that more scenes matched than the request admits; one
    row beyond the request's own limit is kept to see that.  A request meets
    scenes of a window before its last day only (:func:`search_windows`), so the
    pairs exchanged grow with what requests admit, not with what matches.
    """
    day = 86_400_000_000  # a start may be in another kind of time: a day more loses nothing
    zoned = dict(scenes.dtypes)["acquired_at"] == "timestamp"
    timed = scenes.where(F.col("acquired_at").isNotNull()).withColumn("_t", _micros(F.col("acquired_at"), zoned))
    asked = cut_lineage(requests).withColumns({"_low": _micros(F.col("date_start"), zoned) - day, "_high": _micros(F.date_add(F.col("date_end").cast("date"), 1), zoned)})
    last = timed.agg((F.max("_t") + 1).alias("_last"))  # one row
    asked = asked.join(F.broadcast(last), F.lit(True)).withColumn("_high", F.least("_high", "_last")).drop("_last").where("_low < _high")
    # rows that share an id are ranked together: all they match
    counted = asked.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("request_id").alias("_id"))
    several = cut_lineage(counted)
    same = F.col("request_id").eqNullSafe(F.col("_id"))
    windows, widths = search_windows(timed, asked.join(several, same, "left_anti"), size, rows_per_task)
    steps = F.array(*[F.struct(F.lit(k).alias("_step"), F.get(_buckets(w, False), F.lit(0)).alias("_bucket")) for k, w in enumerate(widths)])
    dealt = timed.withColumn("_at", F.explode(steps)).select("*", "_at.*").drop("_at")
    own = F.coalesce(*[F.when(F.col("_step") == k, _buckets(w, True)) for k, w in enumerate(widths)])
    helpers = ["_t", "_low", "_high"]
    pairs = _matching(dealt, windows.withColumn("_bucket", F.explode(own)), size, ("_step", "_bucket"), rows_per_task).drop("_step", "_bucket", *helpers)
    if not several.isEmpty():
        pairs = pairs.unionByName(_matching(timed, asked.join(several, same, "left_semi"), size, (), rows_per_task).drop(*helpers))
    newest = Window.partitionBy("request_id").orderBy(F.desc("acquired_at"), "scene_id")
    ranked = pairs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= F.col("max_results") + 1)
    more = F.max(F.when(F.col("rank") > F.col("max_results"), 1).otherwise(0)).over(Window.partitionBy("request_id"))
    return ranked.withColumn("truncated", more == 1).where(F.col("rank") <= F.col("max_results"))


def order_features(df: DataFrame, keys: Sequence[str] = ("cell_owner", "cell_row", "cell_col")) -> DataFrame:
    """Deterministic output order by the text of the cell key (range sort)."""
    return df.orderBy(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
