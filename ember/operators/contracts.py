"""Data contracts.  Every check returns its violations; empty means passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.functions.geometry import segments_touch, valid_bbox
from ember.functions.projection import lonlat_to_cea


def check_bands(chips: DataFrame, spec: Mapping[str, Sequence[str]], sizes: Mapping[str, tuple[int, int]], dtypes: Mapping[str, str]) -> DataFrame:
    """Band names (in order), shape and dtype of each source against its spec.

    ``chips`` has ``chip_id, key, bands array<string>, height, width, dtype``.
    """
    names = F.create_map(*[x for k, v in spec.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    high = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v[0]))])
    wide = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v[1]))])
    kind = F.create_map(*[x for k, v in dtypes.items() for x in (F.lit(k), F.lit(v))])
    key = F.col("key")
    problem = (
        F.when(names[key].isNull(), "unknown source")
        .when(F.size("bands") != F.size(names[key]), "band count")
        .when(F.col("bands") != names[key], "band names")
        .when((F.col("height") != high[key]) | (F.col("width") != wide[key]), "shape")
        .when(F.col("dtype") != kind[key], "dtype")
    )
    return chips.withColumn("problem", problem).where(F.col("problem").isNotNull())


def check_grids(grids: DataFrame, fields: Sequence[str], chip: str = "chip_id") -> DataFrame:
    """Chips whose inputs (and label) do not share one grid."""
    grid = F.struct(*fields)
    return grids.groupBy(chip).agg(F.count_distinct(grid).alias("n_grids")).where(F.col("n_grids") > 1)


def check_domain(px: DataFrame, column: str, allowed: Sequence[int], finite_only: bool = False) -> DataFrame:
    value = F.col(column)
    bad = ~value.isin(*allowed)
    if finite_only:
        bad = bad & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return px.where(bad)


def check_classes(px: DataFrame, allowed: Sequence[int], columns: Sequence[str] = ("truth", "pred")) -> DataFrame:
    """Pixels whose labels are missing or outside the classes (255 included)."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | ~F.col(c).isin(*allowed)
    return px.where(bad)


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, tagged ``missing`` (left only) or ``extra``."""
    a, b = left.select(key), right.select(key)
    missing = a.exceptAll(b).select(key, F.lit("missing").alias("side"))
    extra = b.exceptAll(a).select(key, F.lit("extra").alias("side"))
    return missing.unionByName(extra)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_feature_order(records: DataFrame, model: DataFrame) -> DataFrame:
    """Records whose feature list is not the model's, in order and unique.

    ``records``: ``id, task, channels, feature_names``; ``model``: one row per
    task with ``task, model_names``.
    """
    joined = records.join(model, "task", "left")
    problem = (
        F.when(F.col("feature_names").isNull() | (F.size("feature_names") == 0), "no names")
        .when(F.size(F.array_distinct("feature_names")) != F.size("feature_names"), "repeated names")
        .when(F.size("feature_names") != F.col("channels"), "channel count")
        .when(F.col("model_names").isNull() | (F.col("feature_names") != F.col("model_names")), "order differs from model")
    )
    return joined.select("id", "task", problem.alias("problem")).where(F.col("problem").isNotNull())


def check_probs(cache: DataFrame, scores: Sequence[str], labels: Sequence[int], tolerance: float = 0.0, truth: str = "truth", valid: str = "valid") -> DataFrame:
    """Pixels with non-finite or out-of-range scores or bad scored labels."""
    bad = F.lit(False)
    for s in scores:
        v = F.col(s).cast("double")
        bad = bad | v.isNull() | F.isnan(v) | (v < -tolerance) | (v > 1 + tolerance)
    problem = F.when(bad, "score").when(
        F.col(valid) & (F.col(truth).isNull() | ~F.col(truth).isin(*labels)), "label"
    )
    return cache.withColumn("problem", problem).where(F.col("problem").isNotNull())


def check_aligned(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("chip_id", "rw", "cl"), same: Sequence[str] = ("truth", "valid")) -> DataFrame:
    """Pixels on one side only, or with different reference or validity."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in same], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in same], F.lit(True).alias("in_b"))
    both = left.join(right, list(keys), "full_outer")
    problem = F.when(F.col("in_b").isNull(), "only in a").when(F.col("in_a").isNull(), "only in b")
    for c in same:
        problem = problem.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs")
    return both.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def check_metrics(actual: DataFrame, expected: DataFrame, tolerance: float, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Recorded metrics that a recomputation does not reproduce."""
    joined = actual.select(*keys, F.col("value").alias("actual")).join(
        expected.select(*keys, F.col("value").alias("expected")), list(keys), "full_outer"
    )
    close = F.abs(F.col("actual") - F.col("expected")) <= tolerance
    return joined.where(~F.coalesce(close, F.lit(False)))


def check_bbox(df: DataFrame, w: str = "w", s: str = "s", e: str = "e", n: str = "n") -> DataFrame:
    return df.where(~valid_bbox(F.col(w), F.col(s), F.col(e), F.col(n)))


def check_rings(vertices: DataFrame, max_vertices: int = 10_000) -> DataFrame:
    """Stored rings that are open, short, outside WGS84, empty or too long.

    ``vertices``: ``aoi_id, part, ring, seq, lon, lat`` with a repeated closing
    vertex; ``part`` tells the polygons of a multipolygon apart (0 if it is
    missing).  Positions are counted over all parts of an area.
    One aggregation per ring; the shoelace sum takes coordinates relative to the
    ring's own first vertex through one lead window.
    """
    if "part" not in vertices.columns:
        vertices = vertices.withColumn("part", F.lit(0))
    by_ring = Window.partitionBy("aoi_id", "part", "ring").orderBy("seq")
    lon, lat = F.col("lon"), F.col("lat")
    step = vertices.select(
        "aoi_id",
        "part",
        "ring",
        "seq",
        "lon",
        "lat",
        F.first("lon").over(by_ring).alias("_lon0"),
        F.first("lat").over(by_ring).alias("_lat0"),
        F.lead("lon").over(by_ring).alias("_lon1"),
        F.lead("lat").over(by_ring).alias("_lat1"),
    )
    finite = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    inside = F.coalesce(finite & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))
    twice = (lon - F.col("_lon0")) * (F.col("_lat1") - F.col("_lat0")) - (F.col("_lon1") - F.col("_lon0")) * (lat - F.col("_lat0"))
    last = F.max_by(F.struct("lon", "lat"), "seq")
    first = F.min_by(F.struct("lon", "lat"), "seq")
    per_ring = step.groupBy("aoi_id", "part", "ring").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.max(F.when(~inside, 1).otherwise(0)).alias("_outside"),
        first.alias("_first"),
        last.alias("_last"),
        (F.abs(F.sum(twice)) / 2).alias("area"),
    )
    whole = Window.partitionBy("aoi_id")
    problem = (
        F.when(F.col("n_vertices") < 4, "too few positions")
        .when(F.col("_first") != F.col("_last"), "not closed")
        .when(F.col("_outside") == 1, "outside WGS84")
        .when(F.sum("n_vertices").over(whole) > max_vertices, "too many vertices")
        .when(F.coalesce(F.col("area"), F.lit(0.0)) == 0, "zero area")
    )
    return per_ring.select("aoi_id", "part", "ring", "n_vertices", problem.alias("problem")).where(F.col("problem").isNotNull())


def strip_closing(vertices: DataFrame, keys: Sequence[str] = ("aoi_id", "part", "ring")) -> DataFrame:
    """Rings without their closing vertex: the last one where it repeats the first."""
    order = Window.partitionBy(*keys).orderBy("seq")
    first, later = F.first(F.struct("lon", "lat")).over(order), F.lead("seq").over(order)
    tagged = vertices.withColumn("_closing", (F.struct("lon", "lat") == first) & later.isNull() & (F.row_number().over(order) > 1))
    return tagged.where(~F.coalesce(F.col("_closing"), F.lit(False))).drop("_closing")


def ring_self_intersections(vertices: DataFrame) -> DataFrame:
    """Open rings (``aoi_id, seq, lon, lat``) with their first failed rule.

    Edges of one ring meet only in tiles of a grid fitted to that ring (about
    as many tiles as edges), so pairs are not enumerated; the exact crossing
    test then runs on the few pairs whose boxes overlap.
    """
    from ember.operators.spatial import box_join

    lon, lat = F.col("lon"), F.col("lat")
    by_ring = Window.partitionBy("aoi_id").orderBy("seq")
    step = vertices.select(
        "aoi_id",
        "seq",
        "lon",
        "lat",
        (F.row_number().over(by_ring) - 1).alias("k"),
        F.lead("lon").over(by_ring).alias("_x2"),
        F.lead("lat").over(by_ring).alias("_y2"),
    )
    inside = F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))
    rings = vertices.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct("lon", "lat")).alias("n_distinct"),
        F.max((~inside).cast("int")).alias("outside"),
        F.min_by(F.struct("lon", "lat"), "seq").alias("head"),
        F.max_by(F.struct("lon", "lat"), "seq").alias("tail"),
        F.min("lon").alias("x_lo"),
        F.min("lat").alias("y_lo"),
        F.max("lon").alias("x_hi"),
        F.max("lat").alias("y_hi"),
    )
    simple = (
        F.when(F.col("n") < 3, "too few vertices")
        .when(F.col("outside") == 1, "outside WGS84")
        .when(F.col("head") == F.col("tail"), "repeated closing vertex")
        .when(F.col("n_distinct") < 3, "too few distinct vertices")
    )
    judged = rings.withColumn("simple", simple)
    # last vertex connects back to the first one
    edges = step.join(judged.where(F.col("simple").isNull()), "aoi_id").select(
        "aoi_id", "k", "n", "x_lo", "y_lo", "x_hi", "y_hi", lon.alias("x1"), lat.alias("y1"), F.coalesce("_x2", F.col("head.lon")).alias("x2"), F.coalesce("_y2", F.col("head.lat")).alias("y2")
    )
    grid = F.ceil(F.sqrt("n"))

    def fit(value: Column, lo: str, hi: str) -> Column:
        return F.coalesce(F.try_divide((value - F.col(lo)) * grid, F.col(hi) - F.col(lo)), F.lit(0.0))

    def side(tag: str) -> DataFrame:
        return edges.select(
            "aoi_id",
            F.col("k").alias(f"{tag}k"),
            F.col("n").alias(f"{tag}n"),
            *[F.col(c).alias(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2")],
            fit(F.least("x1", "x2"), "x_lo", "x_hi").alias(f"{tag}w"),
            fit(F.least("y1", "y2"), "y_lo", "y_hi").alias(f"{tag}s"),
            fit(F.greatest("x1", "x2"), "x_lo", "x_hi").alias(f"{tag}e"),
            fit(F.greatest("y1", "y2"), "y_lo", "y_hi").alias(f"{tag}t"),
        )

    pairs = box_join(side("a"), side("b"), ("aw", "as", "ae", "at"), ("bw", "bs", "be", "bt"), 1.0, keys=("aoi_id",), spread="ak")
    apart = (F.col("bk") > F.col("ak") + 1) & ~((F.col("ak") == 0) & (F.col("bk") == F.col("an") - 1))
    corner = lambda tag, i: (F.col(f"{tag}x{i}"), F.col(f"{tag}y{i}"))
    crossed = pairs.where(apart & segments_touch(corner("a", 1), corner("a", 2), corner("b", 1), corner("b", 2))).select("aoi_id").distinct().withColumn("crossed", F.lit(True))
    twice = edges.groupBy("aoi_id").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("twice"))
    found = judged.join(crossed, "aoi_id", "left").join(twice, "aoi_id", "left")
    problem = F.coalesce(F.col("simple"), F.when(F.col("crossed"), "self-intersection"), F.when(F.col("twice") == 0, "zero area"))
    return found.select("aoi_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def check_periods(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Periods that are missing or not ordered."""
    return df.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) >= F.col(end)))


def check_search_limits(
    df: DataFrame,
    max_area_km2: float = 25_000.0,
    max_edge_m: float = 300_000.0,
    max_positions: int = 1000,
    max_days: int = 366,
    max_results: int = 20,
) -> DataFrame:
    """Searches that are too large, too long or out of range.

    Columns: ``w,s,e,n, n_positions, days, cloud_max, limit``.
    """
    x1, y1 = lonlat_to_cea(F.col("w"), F.col("s"))
    x2, y2 = lonlat_to_cea(F.col("e"), F.col("n"))
    width, height = F.abs(x2 - x1), F.abs(y2 - y1)
    problem = (
        F.when((F.col("e") - F.col("w") > 180) | (F.col("s") < -85) | (F.col("n") > 85), "polar or antimeridian")
        .when((width * height / 1e6 > max_area_km2) | (F.greatest(width, height) > max_edge_m), "area")
        .when(F.col("n_positions") > max_positions, "positions")
        .when((F.col("days") > max_days) | (F.col("days") < 1), "days")
        .when((F.col("cloud_max") < 0) | (F.col("cloud_max") > 100), "cloud")
        .when((F.col("limit") < 1) | (F.col("limit") > max_results), "limit")
    )
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull())


def check_recipe(recipes: DataFrame) -> DataFrame:
    """Weights outside [0, 1] or multipliers that are not 4 positive finite values."""
    m = F.col("class_multipliers")
    bad_m = m.isNotNull() & ((F.size(m) != 4) | F.exists(m, lambda v: v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))))
    bad_w = F.col("tree_weight").isNull() | F.isnan("tree_weight") | ~F.col("tree_weight").between(0, 1)
    problem = F.when(bad_w, "weight").when(bad_m, "multipliers")
    return recipes.withColumn("problem", problem).where(F.col("problem").isNotNull())


def check_pairs(reference: DataFrame, prediction: DataFrame, chip: str = "chip_id") -> DataFrame:
    """Chips missing on one side or with different height or width."""

    def shape(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(chip).agg(
            (F.max("rw") + 1).alias(f"{tag}_h"), (F.max("cl") + 1).alias(f"{tag}_w"), F.count(F.lit(1)).alias(f"{tag}_n")
        )

    both = shape(reference, "ref").join(shape(prediction, "pred"), chip, "full_outer")
    problem = (
        F.when(F.col("pred_n").isNull(), "no prediction")
        .when(F.col("ref_n").isNull(), "no reference")
        .when((F.col("ref_h") != F.col("pred_h")) | (F.col("ref_w") != F.col("pred_w")) | (F.col("ref_n") != F.col("pred_n")), "shape")
    )
    return both.select(chip, problem.alias("problem")).where(F.col("problem").isNotNull())


def check_geo_products(modules: DataFrame, hotspots: DataFrame, contours: DataFrame, slack: float = 1e-6, area_tolerance: float = 1e-3) -> DataFrame:
    """Invariants of exported products, one row per failed rule and request.

    ``modules``: request_id, w,s,e,n, hotspot_count, area_1..area_3,
    burn_area_ha, coverage_fraction.  ``hotspots``: request_id, hotspot_id,
    lon, lat.  ``contours``: request_id, class_id, area_ha.
    """
    box = modules.select("request_id", "w", "s", "e", "n")
    outside = ~(
        F.col("lon").between(F.col("w") - slack, F.col("e") + slack) & F.col("lat").between(F.col("s") - slack, F.col("n") + slack)
    )
    spots = hotspots.join(box, "request_id").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(outside, 1).otherwise(0)).alias("_outside"),
    )
    repeated = (
        hotspots.groupBy("request_id", "hotspot_id").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
        .groupBy("request_id").agg(F.lit(1).alias("_repeated"))
    )
    areas = contours.groupBy("request_id").agg(
        *[F.sum(F.when(F.col("class_id") == c, F.col("area_ha")).otherwise(0.0)).alias(f"_a{c}") for c in (1, 2, 3)]
    )
    all_in = modules.join(spots, "request_id", "left").join(repeated, "request_id", "left").join(areas, "request_id", "left")

    def off(a: Column, b: Column) -> Column:
        return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) > area_tolerance

    rules = {
        "hotspot count": F.coalesce(F.col("hotspot_count"), F.lit(0)) != F.coalesce(F.col("_n"), F.lit(0)),
        "hotspot outside": F.coalesce(F.col("_outside"), F.lit(0)) == 1,
        "repeated hotspot": F.col("_repeated").isNotNull(),
        "class area": off(F.col("area_1"), F.col("_a1")) | off(F.col("area_2"), F.col("_a2")) | off(F.col("area_3"), F.col("_a3")),
        "burn total": off(F.col("burn_area_ha"), F.col("area_1") + F.col("area_2") + F.col("area_3")),
        "coverage": F.coalesce(~((F.col("coverage_fraction") > 0) & (F.col("coverage_fraction") <= 1)), F.lit(False)),
    }
    flags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return all_in.select("request_id", F.explode(flags).alias("problem"))
