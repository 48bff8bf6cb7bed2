"""L and F21-F23: projections, clipping, components, contours and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import longs, rounded
from checks.q_contracts import _cx, _cy
from checks.q_rle import _RLE
from checks.registry import query
from checks.views import HEIGHT, WIDTH
from ember.functions import geometry as G
from ember.functions import projection as P
from ember.operators import areas as A
from ember.operators import components as K
from ember.operators.contracts import strip_closing
from ember.plans import analysis as Y
from ember.plans import inference as I
from ember.session import cut_lineage

# --- Krueger series as text, for the SQL side -------------------------------
_N = 0.0016792203863837047
_R = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_B = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_D = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def lonlat_sql(source: str, keep: str) -> str:
    """``keep, lon, lat`` from rows with x, y, epsg (northern UTM zones)."""
    sinh = lambda v: f"((exp({v})-exp(-({v})))/2)"
    cosh = lambda v: f"((exp({v})+exp(-({v})))/2)"
    xi = "xi" + "".join(f"-({b!r})*sin({2 * j}*xi)*{cosh(f'{2 * j}*eta')}" for j, b in enumerate(_B, 1))
    eta = "eta" + "".join(f"-({b!r})*cos({2 * j}*xi)*{sinh(f'{2 * j}*eta')}" for j, b in enumerate(_B, 1))
    lat = "chi" + "".join(f"+({d!r})*sin({2 * j}*chi)" for j, d in enumerate(_D, 1))
    one = f"SELECT *, CAST(y AS DOUBLE)/{_R!r} AS xi, (CAST(x AS DOUBLE)-500000)/{_R!r} AS eta FROM {source}"
    two = f"SELECT *, {xi} AS xi1, {eta} AS eta1 FROM ({one}) k1"
    three = f"SELECT *, asin(sin(xi1)/{cosh('eta1')}) AS chi FROM ({two}) k2"
    return f"SELECT {keep}, degrees(atan2({sinh('eta1')},cos(xi1)))+(epsg%100)*6-183 AS lon, degrees({lat}) AS lat FROM ({three}) k3"


_XY = "(SELECT c.chip_id, c.pos, m.epsg, m.x_min+20*(c.cl+0.5::DOUBLE) AS x, m.y_max-20*(c.rw+0.5::DOUBLE) AS y FROM fx_class c JOIN fx_meta m USING (chip_id))"


def placed(inp):
    """UTM pixels with their affine transform."""
    meta = inp.fx_meta.select(
        "chip_id", "epsg", F.lit(20.0).alias("ga"), F.lit(0.0).alias("gb"), F.col("x_min").cast("double").alias("gc"),
        F.lit(0.0).alias("gd"), F.lit(-20.0).alias("ge"), F.col("y_max").cast("double").alias("gf"),
    )
    return inp.fx_class.join(meta, "chip_id")


@query("l1_pixel_xy", f"SELECT chip_id, pos, {Q.r('x')} AS x, {Q.r('y')} AS y FROM {_XY} q")
def l1_pixel_xy(inp):
    x, y = P.pixel_xy(F.col("rw"), F.col("cl"), [F.col(c) for c in A.TRANSFORM])
    return rounded(placed(inp).select("chip_id", "pos", x.alias("x"), y.alias("y")))


@query("l2_utm_to_lonlat", f"SELECT chip_id, pos, {Q.r('lon', 8)} AS lon, {Q.r('lat', 8)} AS lat FROM ({lonlat_sql(_XY + ' q', 'chip_id, pos')}) z")
def l2_utm_to_lonlat(inp):
    point = P.pixel_xy(F.col("rw"), F.col("cl"), [F.col(c) for c in A.TRANSFORM])
    out = P.with_lonlat(placed(inp), {"p": point})
    return rounded(out.select("chip_id", "pos", F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat")), 8)


@query("l3_lonlat_to_cea", f"SELECT aoi_id, CAST(seq AS BIGINT) AS seq, {Q.r(_cx('lon'), 4)} AS x, {Q.r(_cy('lat'), 4)} AS y FROM fx_vertex")
def l3_lonlat_to_cea(inp):
    x, y = P.lonlat_to_cea(F.col("lon"), F.col("lat"))
    return longs(rounded(inp.fx_vertex.select("aoi_id", "seq", x.alias("x"), y.alias("y")), 4))


@query(
    "l4_area_ha",
    f"""WITH p AS (SELECT aoi_id, seq, {_cx('lon')} AS x, {_cy('lat')} AS y FROM {Q.OPEN_RINGS} v), o AS (SELECT aoi_id, x AS x0, y AS y0 FROM p WHERE seq=0),
 s AS (SELECT p.aoi_id, x-x0 AS x, y-y0 AS y, lead(x-x0,1,0) OVER w AS nx, lead(y-y0,1,0) OVER w AS ny FROM p JOIN o USING (aoi_id) WINDOW w AS (PARTITION BY p.aoi_id ORDER BY seq))
 SELECT aoi_id, {Q.r('abs(sum(x*ny-nx*y))/2/10000', 3)} AS area_ha FROM s GROUP BY aoi_id""",
)
def l4_area_ha(inp):
    rings = strip_closing(inp.fx_vertex).groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("ring"))
    return rounded(rings.select("aoi_id", P.ring_area_ha(F.col("ring")).alias("area_ha")), 3)


_SIDES = """(SELECT chip_id, epsg, CASE side WHEN 0 THEN x_min+400*t WHEN 1 THEN x_min+400*t WHEN 2 THEN x_min ELSE x_max END AS x, CASE side WHEN 0 THEN y_min WHEN 1 THEN y_max ELSE y_min+300*t END AS y
 FROM fx_meta, range(4) sd(side), (SELECT range/22.0::DOUBLE AS t FROM range(23)) tt)"""


@query("l5_footprint", f"SELECT chip_id, {Q.r('min(lon)', 8)} AS w, {Q.r('min(lat)', 8)} AS s, {Q.r('max(lon)', 8)} AS e, {Q.r('max(lat)', 8)} AS n FROM ({lonlat_sql(_SIDES + ' q', 'chip_id')}) z GROUP BY chip_id")
def l5_footprint(inp):
    return rounded(P.with_footprint(inp.fx_meta, ("w", "s", "e", "n")).select("chip_id", "w", "s", "e", "n"), 8)


@query("l6_bbox_ring", "SELECT request_id, CAST(k AS BIGINT) AS k, " + f"{Q.r('CASE WHEN k IN (1,2) THEN ae ELSE aw END')} AS lon, {Q.r('CASE WHEN k IN (2,3) THEN an ELSE as_ END')} AS lat FROM fx_request, range(5) r(k)")
def l6_bbox_ring(inp):
    ring = G.bbox_ring(F.col("aw"), F.col("as_"), F.col("ae"), F.col("an"))
    return longs(rounded(inp.fx_request.select("request_id", F.posexplode(ring).alias("k", "p")).select("request_id", "k", "p.lon", "p.lat")))


# --- lattice requests --------------------------------------------------------


def geo_scenes(inp):
    g = inp.fx_geo
    west, north = F.lit(30.0) + F.col("gx0") * 0.01, F.lit(50.0) - F.col("gy0") * 0.01
    return g.select(
        "scene_id", "chip_id", "task", F.when(F.col("task") == "af", F.col("acquired_at")).alias("observed_at"), "date_pre", "date_post", "epsg",
        F.lit(0.01).alias("ga"), F.lit(0.0).alias("gb"), west.alias("gc"), F.lit(0.0).alias("gd"), F.lit(-0.01).alias("ge"), north.alias("gf"),
        west.alias("w"), (north - HEIGHT * 0.01).alias("s"), (west + WIDTH * 0.01).alias("e"), north.alias("n"),
        F.lit("src").alias("source_scene_id"), F.col("gy0").alias("grid_row_offset"), F.col("gx0").alias("grid_col_offset"),
    )


def geo_requests(inp):
    day = lambda y: F.to_timestamp_ntz(F.concat(y.cast("string"), F.lit("-01-01")))
    r = inp.fx_aoi.withColumnRenamed("as_", "as").withColumns({"start": day(F.col("start_year")), "end": day(F.col("start_year") + 5)})
    return r.withColumn("task", F.explode(F.array(F.lit("af"), F.lit("bs"))))


def geo_aoi(inp):
    a = A.bbox_aoi(inp.fx_aoi.withColumnRenamed("as_", "as"))
    return a.select("request_id", "edges", "rings", P.ring_area_ha(F.slice(G.bbox_ring(F.col("aw"), F.col("as"), F.col("ae"), F.col("an")), 1, 4)).alias("aoi_ha"))


def geo_pixels(inp):
    """Pixels spread by chip; the one-file test tables would be a single task."""
    return inp.fx_class.select("chip_id", "rw", "cl", "valid", F.when(F.col("task") == "af", (F.col("cls") == 1).cast("bigint")).otherwise(F.col("cls")).alias("cls")).withColumn("score", F.lit(0.5)).repartition(
        inp.spark.sparkContext.defaultParallelism, "chip_id"
    )


_PICKED = """(SELECT r.request_id, g.*, r.aw, r.as_, r.ae, r.an FROM fx_geo g JOIN fx_aoi r ON 30+gx0*0.01<=r.ae AND r.aw<=30+gx0*0.01+0.2 AND 50-gy0*0.01-0.15<=r.an AND r.as_<=50-gy0*0.01
 WHERE CASE WHEN task='af' THEN acquired_at ELSE date_post END>=make_timestamp(start_year,1,1,0,0,0.0) AND CASE WHEN task='af' THEN acquired_at ELSE date_post END<make_timestamp(start_year+5,1,1,0,0,0.0))"""
_OBS = f"""(SELECT k.*, gx0+c.cl AS gx, gy0+c.rw AS gy, c.rw, c.cl, CASE WHEN k.task='af' THEN CASE WHEN c.cls=1 THEN 1 ELSE 0 END ELSE c.cls END AS cls,
 30+(gx0+c.cl)*0.01 AS x1, 30+(gx0+c.cl+1)*0.01 AS x2, 50-(gy0+c.rw+1)*0.01 AS y1, 50-(gy0+c.rw)*0.01 AS y2 FROM {_PICKED} k JOIN fx_class c USING (chip_id) WHERE c.valid)"""
_CLIP = f"(greatest(0,{_cx('least(x2,ae)')}-{_cx('greatest(x1,aw)')})*greatest(0,{_cy('least(y2,an)')}-{_cy('greatest(y1,as_)')})/10000)"
_CLIPPED = f"CASE WHEN least(x2,ae)>greatest(x1,aw) AND least(y2,an)>greatest(y1,as_) THEN {_CLIP} ELSE 0 END"
_SPOTS = f"""(SELECT request_id, scene_id, gx, gy, x1+0.005 AS lon, y1+0.005 AS lat FROM (SELECT *, row_number() OVER (PARTITION BY request_id, acquired_at, gx, gy ORDER BY least(rw+1,cl+1,{HEIGHT}-rw,{WIDTH}-cl) DESC, scene_id) AS k FROM {_OBS} o WHERE task='af') q
 WHERE k=1 AND cls=1 AND x1+0.005 BETWEEN aw AND ae AND y1+0.005 BETWEEN as_ AND an)"""
_MOSAIC = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, gx, gy ORDER BY date_post DESC, scene_id) AS k, {_CLIPPED} AS ha FROM {_OBS} o WHERE task='bs') q WHERE k=1)"


def observed(inp):
    return Y.newest_observations(geo_requests(inp), geo_scenes(inp), geo_pixels(inp))


@query("l7_clip_cells", f"SELECT request_id, gx, gy, {Q.r('ha', 4)} AS inside_ha, scene_id FROM {_MOSAIC} m WHERE ha>1e-9")
def l7_clip_cells(inp):
    cells = Y.burned_cells(observed(inp), geo_aoi(inp)).where("inside_ha > 1e-9")
    return rounded(cells.select("request_id", (F.col("gx") - 3000).alias("gx"), (4999 - F.col("gy")).alias("gy"), "inside_ha", "scene_id"), 4)


@query("l8_hotspots", f"SELECT request_id, scene_id, {Q.r('lon', 5)} AS lon, {Q.r('lat', 5)} AS lat, 0.5::DOUBLE AS score FROM {_SPOTS} s")
def l8_hotspots(inp):
    spots = Y.seen_hotspots(geo_requests(inp), geo_scenes(inp), geo_pixels(inp), geo_aoi(inp), F.lit(HEIGHT), F.lit(WIDTH))
    return rounded(spots.select("request_id", "scene_id", "lon", "lat", "score"), 5)


@query("f21_severity_areas", f"SELECT request_id, " + ", ".join(f"{Q.r(f'sum(CASE WHEN cls={c} THEN ha ELSE 0 END)', 4)} AS area_{c}" for c in (1, 2, 3)) + f", {Q.r('sum(CASE WHEN cls>0 THEN ha ELSE 0 END)', 4)} AS burn_area_ha FROM {_MOSAIC} m WHERE ha>1e-9 GROUP BY request_id")
def f21_severity_areas(inp):
    cells = Y.burned_cells(observed(inp), geo_aoi(inp)).where("inside_ha > 1e-9")
    return rounded(A.severity_areas(cells, ["request_id"]), 4)


_AOI_HA = f"({_cx('ae')}-{_cx('aw')})*({_cy('an')}-{_cy('as_')})/10000"
_COVER = f"""(SELECT r.request_id, t.task, {_AOI_HA} AS aoi_ha, coalesce(n,0) AS observation_count, least(coalesce(seen,0),{_AOI_HA}) AS seen FROM fx_aoi r CROSS JOIN (VALUES ('af'),('bs')) t(task)
 LEFT JOIN (SELECT request_id, task, count(*) AS n FROM {_PICKED} p GROUP BY request_id, task) k ON k.request_id=r.request_id AND k.task=t.task
 LEFT JOIN (SELECT request_id, task, sum(ha) AS seen FROM (SELECT DISTINCT request_id, task, gx, gy, {_CLIPPED} AS ha FROM {_OBS} o) d GROUP BY request_id, task) v ON v.request_id=r.request_id AND v.task=t.task)"""


@query("f22_coverage", f"SELECT request_id, task, observation_count, {Q.r('aoi_ha', 3)} AS aoi_ha, {Q.r('seen', 3)} AS observed_area_ha, {Q.r('aoi_ha-seen', 3)} AS unobserved_area_ha, {Q.r('seen/aoi_ha', 5)} AS coverage_fraction FROM {_COVER} c")
def f22_coverage(inp):
    from ember.operators.spatial import select_scenes

    rq = geo_requests(inp)
    n = select_scenes(geo_scenes(inp), rq).groupBy("request_id", "task").agg(F.count(F.lit(1)).alias("observation_count"))
    wanted = rq.select("request_id", "task").join(geo_aoi(inp).select("request_id", "aoi_ha"), "request_id").join(n, ["request_id", "task"], "left").withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    # read twice below, and small: written once
    cov = cut_lineage(A.coverage(Y.observed_cells(observed(inp), geo_aoi(inp)), wanted, ["request_id", "task"]))
    return rounded(cov.withColumn("coverage_fraction", F.round("coverage_fraction", 5)), 3).drop("coverage_fraction").join(cov.select("request_id", "task", (F.round("coverage_fraction", 5) + 0.0).alias("coverage_fraction")), ["request_id", "task"])


_STATUS = "CASE WHEN seen=0 THEN 'no_data' WHEN seen/aoi_ha>=1-1e-8 THEN 'complete' ELSE 'partial' END"


@query("f23_module_status", f"SELECT request_id, CASE WHEN count(CASE WHEN st<>'no_data' THEN 1 END)=0 THEN 'no_data' WHEN count(CASE WHEN st<>'complete' THEN 1 END)=0 THEN 'complete' ELSE 'partial' END AS data_status FROM (SELECT request_id, {_STATUS} AS st FROM {_COVER} c) q GROUP BY request_id")
def f23_module_status(inp):
    report = Y.analyse(geo_requests(inp), geo_scenes(inp), geo_pixels(inp), geo_aoi(inp), F.lit(HEIGHT), F.lit(WIDTH))
    return A.overall_status(report)


_COMP = """WITH RECURSIVE px AS (SELECT chip_id, rw, cl, pos, cls FROM fx_class WHERE cls>0), adj AS (SELECT a.chip_id, a.pos AS u, b.pos AS v FROM px a JOIN px b ON a.chip_id=b.chip_id AND a.cls=b.cls AND abs(a.rw-b.rw)+abs(a.cl-b.cl)=1 AND abs(a.pos-b.pos)<=20),
 reach AS (SELECT chip_id, pos AS u, pos AS v FROM px UNION SELECT r.chip_id, r.u, a.v FROM reach r JOIN adj a ON a.chip_id=r.chip_id AND a.u=r.v),
 comp AS (SELECT chip_id, u AS pos, min(v) AS comp FROM reach GROUP BY chip_id, u)"""


@query("l9_components", f"{_COMP} SELECT px.chip_id, px.cls, comp, count(*) AS pixels, min(rw) AS top, min(cl) AS \"left\", max(rw) AS bottom, max(cl) AS \"right\" FROM px JOIN comp USING (chip_id, pos) GROUP BY ALL")
def l9_components(inp):
    return longs(K.component_report(K.components(inp.fx_class)))


@query("l10_contours", f"{_COMP} SELECT px.chip_id, comp, px.cls, CAST(count(*) AS DOUBLE) AS area_px FROM px JOIN comp USING (chip_id, pos) GROUP BY ALL")
def l10_contours(inp):
    rings = K.contours(K.components(inp.fx_class))
    signed = K.planar_ring_area(F.col("line")) * F.when(F.col("hole"), -1).otherwise(1)
    return longs(rings.groupBy("chip_id", "comp", "cls").agg(F.sum(signed).alias("area_px")))


@query("l10_contour_features")
def l10_contour_features(inp):
    """Contours as lon/lat rings with hectares, one row per ring."""
    from ember.functions.text import severity_name

    meta = placed(inp).select("chip_id", "epsg", *A.TRANSFORM).distinct()
    rings = K.contours(K.components(inp.fx_class)).join(meta, "chip_id")
    t = [F.col(c) for c in A.TRANSFORM]

    def corner(p):
        x, y = P.pixel_xy(p["r"], p["c"], t, centre=False)
        return F.struct(x.alias("x"), y.alias("y"))

    corners = F.transform(F.slice("line", 1, F.size("line") - 1), corner)
    lines = rings.withColumn("lonlat", P.ring_to_lonlat(corners, F.col("epsg")))
    return rounded(lines.select("chip_id", "comp", "ring", "hole", severity_name(F.col("cls")).alias("severity"), P.ring_area_ha(F.col("lonlat")).alias("area_ha")))


# visible fires as 4-connected regions; holes follow from Euler's formula
_REGIONS = f"""fire AS (SELECT request_id, gx, gy, cls, ha, scene_id, date_post, row_number() OVER (ORDER BY request_id, gx, gy) AS u FROM {_MOSAIC} m WHERE cls>0 AND ha>1e-9),
 near AS (SELECT a.u, b.u AS v FROM fire a JOIN fire b ON a.request_id=b.request_id AND a.cls=b.cls AND ((a.gx=b.gx AND abs(a.gy-b.gy)=1) OR (a.gy=b.gy AND abs(a.gx-b.gx)=1))),
 grown AS (SELECT u, u AS v FROM fire UNION SELECT g.u, n.v FROM grown g JOIN near n ON n.u=g.v),
 part AS (SELECT u, min(v) AS comp FROM grown GROUP BY u),
 block AS (SELECT a.u FROM fire a JOIN fire b ON b.request_id=a.request_id AND b.cls=a.cls AND b.gx=a.gx+1 AND b.gy=a.gy JOIN fire c ON c.request_id=a.request_id AND c.cls=a.cls AND c.gx=a.gx AND c.gy=a.gy+1
  JOIN fire d ON d.request_id=a.request_id AND d.cls=a.cls AND d.gx=a.gx+1 AND d.gy=a.gy+1),
 region AS (SELECT request_id, cls, comp, min(gx) AS gx, max(gy) FILTER (gx=lowest) AS gy, count(*) AS cells, sum(ha) AS ha, CAST(sum(touch) AS BIGINT) AS touch, CAST(sum(full_) AS BIGINT) AS full_, max(date_post) AS date_post, string_agg(DISTINCT scene_id, ',' ORDER BY scene_id) AS scenes
  FROM (SELECT f.*, comp, min(gx) OVER (PARTITION BY comp) AS lowest, (SELECT count(*) FROM near n WHERE n.u=f.u) AS touch, (SELECT count(*) FROM block k WHERE k.u=f.u) AS full_ FROM fire f JOIN part USING (u)) q GROUP BY request_id, cls, comp)"""


@query(
    "l10_visible_contours",
    f"""WITH RECURSIVE {_REGIONS} SELECT request_id, cls, gx, gy, cells, {Q.r('ha', 4)} AS area_ha, 2-cells+touch//2-full_ AS rings, 4*cells-touch AS sides, cells AS enclosed, true AS closed, CAST(date_post AS VARCHAR) AS date_post, scenes FROM region""",
)
def l10_visible_contours(inp):
    """Regions of the newest visible class over all chips and scenes of a request."""
    # the rounds of the contours read the cells many times: write them once
    cells = cut_lineage(Y.burned_cells(observed(inp), geo_aoi(inp)).where("inside_ha > 1e-9"))
    regions, _ = Y.burn_contours(cells)
    x, y = F.shiftright("outer", 31) - (1 << 28), F.shiftright("outer", 2).bitwiseAND((1 << 29) - 1) - (1 << 28)
    return longs(
        rounded(
            regions.select(
                "request_id", "cls", (x - 3000).alias("gx"), (4999 - y).alias("gy"), "cells", "area_ha", "rings", "sides", "enclosed", "closed",
                F.date_format("date_post", "yyyy-MM-dd HH:mm:ss").alias("date_post"), F.array_join("source_scene_ids", ",").alias("scenes"),
            ),
            4,
        )
    )


@query(
    "l12_analyse",
    f"""WITH RECURSIVE {_REGIONS} SELECT c.request_id, c.task, {_STATUS} AS data_status, observation_count, coalesce(CASE WHEN seen>0 AND c.task='af' THEN coalesce(h.n,0) END,-1) AS hotspot_count, {Q.r("CASE WHEN seen>0 AND c.task='bs' THEN coalesce(b.burn,0) END", 4)} AS burn_area_ha, {Q.r("CASE WHEN seen>0 AND c.task='bs' THEN coalesce(b.a3,0) END", 4)} AS area_3, coalesce(CASE WHEN seen>0 AND c.task='bs' THEN coalesce(g.n,0) END,-1) AS contour_count, coalesce(CASE WHEN seen>0 AND c.task='bs' THEN coalesce(g.rings,0) END,-1) AS ring_count
 FROM {_COVER} c LEFT JOIN (SELECT request_id, 'af' AS task, count(*) AS n FROM {_SPOTS} s GROUP BY request_id) h ON h.request_id=c.request_id AND h.task=c.task
 LEFT JOIN (SELECT request_id, 'bs' AS task, sum(CASE WHEN cls>0 THEN ha ELSE 0 END) AS burn, sum(CASE WHEN cls=3 THEN ha ELSE 0 END) AS a3 FROM {_MOSAIC} m GROUP BY request_id) b ON b.request_id=c.request_id AND b.task=c.task
 LEFT JOIN (SELECT request_id, 'bs' AS task, count(*) AS n, CAST(sum(2-cells+touch//2-full_) AS BIGINT) AS rings FROM region GROUP BY request_id) g ON g.request_id=c.request_id AND g.task=c.task""",
)
def l12_analyse(inp):
    report = Y.analyse(geo_requests(inp), geo_scenes(inp), geo_pixels(inp), geo_aoi(inp), F.lit(HEIGHT), F.lit(WIDTH))
    return rounded(report.select("request_id", "task", "data_status", "observation_count", F.coalesce("hotspot_count", F.lit(-1)).alias("hotspot_count"), "burn_area_ha", "area_3", *[F.coalesce(m, F.lit(-1)).alias(m) for m in ("contour_count", "ring_count")]), 4)


@query("l11_priority_class", "SELECT rw, cl, max(cls) AS cls FROM fx_class WHERE valid GROUP BY rw, cl")
def l11_priority_class(inp):
    return A.priority_class(inp.fx_class.where("valid"), ["rw", "cl"])


@query(
    "l13_predict_products",
    f"""SELECT m.chip_id, kind AS task, CAST({HEIGHT} AS BIGINT) AS height, CAST({WIDTH} AS BIGINT) AS width, chip_id%3=0 AS georeferenced, string_agg(CAST(k.class_id AS VARCHAR)||':'||coalesce(rle,''), '|' ORDER BY k.class_id) AS rles
 FROM fx_meta m JOIN (VALUES (1),(2),(3)) k(class_id) ON kind='bs' OR k.class_id=1 LEFT JOIN {_RLE} r USING (chip_id, class_id) WHERE chip_id IN (SELECT o_custkey FROM orders) GROUP BY ALL""",
)
def l13_predict_products(inp):
    wanted = inp.orders.select(F.col("o_custkey").alias("chip_id"))
    sc = inp.fx_meta.select("chip_id", F.col("kind").alias("task"), (F.col("chip_id") % 3 == 0).alias("georeferenced"))
    out = I.chip_products(wanted, inp.fx_class.drop("task"), sc)
    text = F.array_join(F.transform("rles", lambda x: F.concat_ws(":", x["class_id"].cast("string"), x["rle"])), "|")
    return longs(out.withColumn("rles", text))


@query("l14_planar_area", "SELECT chip_id, count(*) AS pixels, CAST(count(*)*400 AS DOUBLE) AS area FROM fx_class WHERE cls>0 GROUP BY chip_id")
def l14_planar_area(inp):
    return A.planar_area(placed(inp).where("cls > 0"), ["chip_id"])
