"""Rectangle, interval and polygon joins over tiles.

Two boxes meet in the tile that holds the lower-left corner of their
intersection, and in that tile only: pairs come out exactly once without a
distinct.  Tile keys are equi-join keys; hot tiles are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.functions import geometry as G
from ember.operators.indexing import salted_join


def _floor(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def _tile(value: Column, size: float) -> Column:
    return _floor(value / F.lit(float(size)))


def tile_boxes(df: DataFrame, w: str, s: str, e: str, n: str, size: float) -> DataFrame:
    """One row per tile a closed box touches, with ``tx, ty``."""
    xs = F.sequence(_tile(F.col(w), size), _tile(F.col(e), size))
    ys = F.sequence(_tile(F.col(s), size), _tile(F.col(n), size))
    return df.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))


def box_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Sequence[str],
    right_box: Sequence[str],
    size: float,
    keys: Sequence[str] = (),
    spread: str | None = None,
    touching: bool = True,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Pairs of boxes that overlap; ``touching`` also admits shared edges.

    Column names of the two sides must differ except for ``keys``.  ``size``
    should be near the larger box size, so that a box falls into few tiles.
    """
    lw, ls, le, ln = left_box
    rw, rs, re, rn = right_box
    tiled_left = tile_boxes(left, lw, ls, le, ln, size)
    tiled_right = tile_boxes(right, rw, rs, re, rn, size)
    pairs = salted_join(tiled_left, tiled_right, [*keys, "tx", "ty"], F.col(spread) if spread else F.xxhash64(*left.columns), rows_per_task)
    if touching:
        meets = (F.col(lw) <= F.col(re)) & (F.col(rw) <= F.col(le)) & (F.col(ls) <= F.col(rn)) & (F.col(rs) <= F.col(ln))
    else:
        meets = (F.least(le, re) > F.greatest(lw, rw)) & (F.least(ln, rn) > F.greatest(ls, rs))
    home = (F.col("tx") == _tile(F.greatest(lw, rw), size)) & (F.col("ty") == _tile(F.greatest(ls, rs), size))
    return pairs.where(meets & home).drop("tx", "ty")


def _cell(x: Column, y: Column, bits: int) -> Column:
    """Z-order number of the cell, ``2 ** bits`` an axis, that holds a place given in tiles."""
    at = [F.floor((c - F.floor(c)) * (1 << bits)).cast("int") for c in (x, y)]
    parts = [F.shiftleft(F.shiftright(c, i).bitwiseAND(1), 2 * i + axis) for axis, c in enumerate(at) for i in range(bits)]
    return sum(parts[1:], parts[0])


def blocked_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Sequence[str],
    right_box: Sequence[str],
    size: float,
    keys: Sequence[str] = (),
    moment: str | None = None,
    period: Sequence[str] = (),
    rows_per_task: int = 2_000_000,
    per_block: int = 32,
    per_book: int = 4096,
) -> DataFrame:
    """Pairs of :func:`box_join` (touching), found by blocks of left boxes.

    A left box lies in the one tile that holds its lower-left corner, right
    boxes take every tile in which such a corner can be; left boxes much above
    ``size`` get tiles of their own, doubled in width (their sizes, a few rows,
    are read first).  Up to ``per_block`` neighbours of a tile travel as one row
    and meet a right box together; only boxes of blocks that reach it are tested
    one by one.  With ``moment`` (a left column) and ``period`` (start and end of
    a right row, half-open, null: open) a pair must agree in time, too.
    Columns of the two sides must differ except for ``keys``.  Tiles of more than
    ``rows_per_task`` left rows are salted, those of more than ``per_book`` right
    rows are cut into books, so that a block makes a bounded number of pairs at a time.
    """
    keys, tasks = list(keys), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (w, s, e, n), (rw, rs, re, rn) = map(F.col, left_box), map(F.col, right_box)
    width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_level"))
    level = F.greatest(F.coalesce(F.ceil(F.log2(F.greatest(e - w, n - s) / float(size))), F.lit(0)), F.lit(0)).cast("int")
    placed = left.where(w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()).withColumn("_level", level)
    sides = placed.groupBy("_level").agg(F.max(e - w).alias("x"), F.max(n - s).alias("y")).collect()
    placed = placed.withColumns({"tx": _floor(w / width), "ty": _floor(s / width)})
    reach = F.array(*[F.struct(F.lit(r["_level"]).alias("_level"), F.lit(float(r["x"])).alias("_x"), F.lit(float(r["y"])).alias("_y")) for r in sides])
    asked = right.select("*", F.inline(reach if sides else reach.cast("array<struct<_level:int,_x:double,_y:double>>")))

    def tiles(low: Column, high: Column, side: Column) -> Column:
        first = _floor((low - side - (F.abs(low) + F.abs(side)) * 2.0**-40) / width)  # a little early: differences are rounded
        return F.when(first <= _floor(high / width), F.sequence(first, _floor(high / width)))

    asked = asked.withColumn("tx", F.explode(tiles(rw, re, F.col("_x")))).withColumn("ty", F.explode(tiles(rs, rn, F.col("_y")))).drop("_x", "_y")
    tile = [*keys, "_level", "tx", "ty"]

    def parts(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*tile, F.ceil(F.col("_n") / most).cast("int").alias(name))

    def drawn(df: DataFrame, of: DataFrame, total: str, name: str) -> DataFrame:
        return df.withColumn(name, F.when(F.col(total).isNull(), 0).otherwise(F.pmod(F.xxhash64(*of.columns), F.col(total)).cast("int"))).drop(total)

    def copied(df: DataFrame, total: str, name: str) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(total), F.lit(1)) - 1))).drop(total)

    salts, books = parts(placed, rows_per_task, "_salts"), parts(asked, per_book, "_books")
    spread = drawn(placed.join(salts, tile, "left"), left, "_salts", "_salt")
    near = [_cell(w / width, s / width, 2 if moment else 5), F.col(moment) if moment else w]
    number = F.row_number().over(Window.partitionBy(*tile, "_salt").orderBy(*near))
    rest = [c for c in left.columns if c not in keys]
    ends = {"_w": F.min(w), "_s": F.min(s), "_e": F.max(e), "_n": F.max(n)}
    if moment:
        ends |= {"_first": F.min(moment), "_last": F.max(moment)}
    blocks = spread.withColumn("_block", F.floor((number - 1) / per_block)).groupBy(*tile, "_salt", "_block").agg(
        F.collect_list(F.struct(*rest)).alias("_members"), *[v.alias(k) for k, v in ends.items()]
    ).drop("_block")
    blocks = copied(blocks.join(books, tile, "left"), "_books", "_book")
    asked = copied(drawn(asked.join(books, tile, "left"), right, "_books", "_book").join(salts, tile, "left"), "_salts", "_salt")

    def agree(w: Column, s: Column, e: Column, n: Column, first: str | None, last: str | None) -> Column:
        meets = (w <= re) & (rw <= e) & (s <= rn) & (rs <= n)
        if not moment:
            return meets
        start, end = map(F.col, period)
        return meets & (start.isNull() | (F.col(last) >= start)) & (end.isNull() | (F.col(first) < end))

    on = [*tile, "_salt", "_book"]
    met = blocks.repartition(tasks, *on).join(asked.repartition(tasks, *on), on).where(agree(*map(F.col, ("_w", "_s", "_e", "_n")), "_first", "_last"))
    others = [c for c in right.columns if c not in keys]
    return met.select(*keys, *others, F.inline("_members")).where(agree(w, s, e, n, moment, moment)).select(*keys, *rest, *others)


#: Coarsest tiles of :func:`sized_join` are 2^COARSEST wide.
COARSEST = 8


def sized_join(
    left: DataFrame, right: DataFrame, left_box: Sequence[str], right_box: Sequence[str], finest: int, keys: Sequence[str] = (), rows_per_task: int = 2_000_000
) -> DataFrame:
    """:func:`box_join` of small boxes with boxes of very different sizes.

    A right box takes tiles of a power of two near half its longer side, so it
    falls into few tiles whatever its size and meets little beyond itself.  Left
    boxes are dealt to every size that occurs, at most ``COARSEST - finest + 1``
    (read first); ``2 ** finest`` should not be below the size of a left box.
    Scaling by powers of two is exact.
    """
    w, s, e, n = map(F.col, right_box)
    level = (F.ceil(F.log2(F.greatest(F.abs(e - w), F.abs(n - s)))) - 1).cast("int")
    asked = right.withColumn("_level", F.least(F.greatest(F.coalesce(level, F.lit(finest)), F.lit(finest)), F.lit(max(finest, COARSEST))))
    levels = [F.lit(r["_level"]) for r in asked.select("_level").distinct().collect()]
    dealt = left.withColumn("_level", F.explode(F.array(*levels).cast("array<int>")))
    scale = F.pow(F.lit(2.0), -F.col("_level"))
    scaled = {side: [f"_{side}{i}" for i in range(4)] for side in ("l", "r")}
    dealt = dealt.withColumns({name: F.col(c) * scale for name, c in zip(scaled["l"], left_box)})
    asked = asked.withColumns({name: F.col(c) * scale for name, c in zip(scaled["r"], right_box)})
    pairs = box_join(dealt, asked, scaled["l"], scaled["r"], 1.0, (*keys, "_level"), rows_per_task=rows_per_task)
    return pairs.drop("_level", *scaled["l"], *scaled["r"])


def scene_moment() -> Column:
    """The time that decides whether a scene lies in a period."""
    return F.when(F.col("task") == "af", F.col("observed_at")).otherwise(F.col("date_post"))


def selectable() -> Column:
    """Scenes with a time; burn scenes need ``date_pre < date_post``."""
    return scene_moment().isNotNull() & ((F.col("task") == "af") | (F.col("date_pre") < F.col("date_post")))


def select_scenes(scenes: DataFrame, requests: DataFrame, size: float = 5.0, rows_per_task: int = 2_000_000, columns: Sequence[str] | None = None) -> DataFrame:
    """Scenes each request asks for by task, period and area of interest.

    ``scenes``: scene_id, task, observed_at (AF) or date_pre/date_post (BS) and
    bounds ``w,s,e,n``; optional ``chip_id``.  ``requests``: request_id, task
    (one row per requested task), start, end (half-open), bounds ``aw,as,ae,an``
    and optionally ``edges`` (polygon) and ``only_chip``.  Burn scenes need
    ``date_pre < date_post``; the later date decides the period.  ``columns``
    names those to return (all if not given); others do not travel.
    """
    only, shaped = "only_chip" in requests.columns, "edges" in requests.columns
    ready = scenes.withColumn("_moment", scene_moment()).where(selectable())
    if columns is not None:
        ready = ready.select([c for c in ready.columns if c in {*columns, "task", "_moment", "w", "s", "e", "n", *(["chip_id"] if only else [])}])
        requests = requests.select([c for c in requests.columns if c in {*columns, "task", "start", "end", "aw", "as", "ae", "an", "edges", "only_chip"}])
    pairs = blocked_join(
        ready, requests, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), size, keys=("task",), moment="_moment", period=("start", "end"), rows_per_task=rows_per_task
    )
    if only:
        pairs = pairs.where(F.col("only_chip").isNull() | (F.col("chip_id") == F.col("only_chip")))
    if shaped:
        pairs = pairs.where(G.box_intersects(F.col("edges"), F.col("w"), F.col("s"), F.col("e"), F.col("n")))
    return pairs.drop("_moment") if columns is None else pairs.select(*columns)


def split_grids(meta: DataFrame, split: DataFrame) -> DataFrame:
    """Distinct grids per split: ``split, epsg, x_min..y_max``."""
    return meta.join(split, "chip_id").select("split", "epsg", "x_min", "y_min", "x_max", "y_max").distinct()


def split_overlap(grids: DataFrame, size: float = 10_240.0, rows_per_task: int = 2_000_000) -> DataFrame:
    """Train/validation grid pairs that share a positive area in one CRS."""
    cols = ("x_min", "y_min", "x_max", "y_max")
    train = grids.where(F.col("split") == "train").select("epsg", *[F.col(c).alias(f"train_{c}") for c in cols])
    val = grids.where(F.col("split") == "val").select("epsg", *[F.col(c).alias(f"val_{c}") for c in cols])
    return box_join(
        train,
        val,
        [f"train_{c}" for c in cols],
        [f"val_{c}" for c in cols],
        size,
        keys=("epsg",),
        touching=False,
        rows_per_task=rows_per_task,
    )


def common_grids(left: DataFrame, right: DataFrame, columns: Sequence[str] = ("epsg", "x_min", "y_min")) -> DataFrame:
    """Grids that occur on both sides."""
    return left.select(*columns).intersect(right.select(*columns))


def shared_grids(grids: DataFrame) -> DataFrame:
    """Grids that occur in both splits."""
    cols = ("epsg", "x_min", "y_min", "x_max", "y_max")
    return grids.where(F.col("split") == "train").select(*cols).intersect(grids.where(F.col("split") == "val").select(*cols))


def overlap_report(meta: DataFrame, split: DataFrame, size: float = 10_240.0) -> DataFrame:
    """One row: chips, unique grids, exact and positive-area leakage."""
    grids = split_grids(meta, split)
    per_split = grids.agg(
        F.count_if(F.col("split") == "train").alias("train_unique_grids"),
        F.count_if(F.col("split") == "val").alias("validation_unique_grids"),
    )
    exact = shared_grids(grids).agg(F.count(F.lit(1)).alias("exact_shared_grids"))
    pairs = split_overlap(grids, size)
    train_key = F.struct("epsg", "train_x_min", "train_y_min", "train_x_max", "train_y_max")
    val_key = F.struct("epsg", "val_x_min", "val_y_min", "val_x_max", "val_y_max")
    counted = pairs.agg(
        F.count(F.lit(1)).alias("overlapping_pairs"),
        F.count_distinct(train_key).alias("affected_train_grids"),
        F.count_distinct(val_key).alias("affected_validation_grids"),
    )
    chips = meta.agg(F.count(F.lit(1)).alias("chips"))
    one = chips
    for part in (per_split, exact, counted):
        # every part is an ungrouped aggregate, i.e. exactly one row
        one = one.join(F.broadcast(part), F.lit(True))
    return one.withColumn("passes", F.col("overlapping_pairs") == 0)


def polygon_edges(vertices: DataFrame, keys: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Closed rings (``part, ring, seq, lon, lat``) to one edge array and bounds per AOI."""
    w = Window.partitionBy(*keys, "part", "ring").orderBy("seq")
    step = vertices.withColumn("_x2", F.lead("lon").over(w)).withColumn("_y2", F.lead("lat").over(w))
    edge = F.when(
        F.col("_x2").isNotNull(),
        F.struct(F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("_x2").alias("x2"), F.col("_y2").alias("y2")),
    )
    return step.groupBy(*keys).agg(
        F.array_sort(F.collect_list(edge)).alias("edges"),
        F.min("lon").alias("aw"),
        F.min("lat").alias("as"),
        F.max("lon").alias("ae"),
        F.max("lat").alias("an"),
    )


def points_in_aoi(points: DataFrame, aoi: DataFrame, size: float = 1.0, lon: str = "lon", lat: str = "lat", rows_per_task: int = 2_000_000) -> DataFrame:
    """Pairs of points and polygons that cover them (boundary included).

    ``aoi`` comes from :func:`polygon_edges`.  Points meet only the polygons
    whose bounding box touches their tile; the exact test is a fold over the
    polygon's edges inside the row.
    """
    placed = points.withColumn("tx", _tile(F.col(lon), size)).withColumn("ty", _tile(F.col(lat), size))
    tiled = tile_boxes(aoi, "aw", "as", "ae", "an", size)
    pairs = salted_join(placed, tiled, ["tx", "ty"], F.xxhash64(*points.columns), rows_per_task)
    in_box = F.col(lon).between(F.col("aw"), F.col("ae")) & F.col(lat).between(F.col("as"), F.col("an"))
    return pairs.where(in_box).where(G.covers(F.col("edges"), F.col(lon), F.col(lat))).drop("tx", "ty")


def footprints_intersecting(scenes: DataFrame, aoi: DataFrame, size: float = 5.0, rows_per_task: int = 2_000_000) -> DataFrame:
    """Scene boxes that share a point with an AOI polygon."""
    pairs = box_join(scenes, aoi, ("w", "s", "e", "n"), ("aw", "as", "ae", "an"), size, rows_per_task=rows_per_task)
    return pairs.where(G.box_intersects(F.col("edges"), F.col("w"), F.col("s"), F.col("e"), F.col("n")))
