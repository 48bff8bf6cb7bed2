"""E, I and J2: joins, scene selection, winners and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import longs, rounded
from checks.registry import query
from ember.operators import contracts as K
from ember.operators import cover as V
from ember.operators import joins as J
from ember.operators import pixels as P
from ember.operators import ranking as N
from ember.operators import spatial as X
from ember.session import cut_lineage

KEY = "chip_id, rw, cl"


@query("e1_join_labels", f"SELECT a.chip_id, a.rw, a.cl, {Q.r('a.dem')} AS dem, c.cls AS y FROM fx_af a JOIN fx_class c USING (chip_id, rw, cl)")
def e1_join_labels(inp):
    px = inp.fx_af.select("chip_id", "rw", "cl", "dem")
    return rounded(P.join_labels(px, inp.fx_class.select("chip_id", "rw", "cl", F.col("cls").alias("y"))))


@query("e2_join_scores", f"SELECT {KEY}, {Q.r('t1')} AS t1, {Q.r('n1')} AS n1 FROM fx_pixel")
def e2_join_scores(inp):
    a, b = inp.fx_pixel.select("chip_id", "rw", "cl", "t1"), inp.fx_pixel.select("chip_id", "rw", "cl", "n1")
    return rounded(J.join_scores(a, b))


def supplied(inp):
    """Benchmark items as chip metadata: whatever chips they do not cover lack it."""
    return inp.benchmark.select(F.col("item_id").alias("chip_id"), F.concat(F.lit("n"), (F.length("text") % 7).cast("string")).alias("kind"))


@query("e3_with_meta", "SELECT c.chip_id, pos, coalesce(kind,'none') AS kind, kind IS NOT NULL AS has_meta FROM fx_class c LEFT JOIN (SELECT item_id AS chip_id, 'n'||CAST(length(text)%7 AS VARCHAR) AS kind FROM benchmark) m USING (chip_id)")
def e3_with_meta(inp):
    return J.with_meta(inp.fx_class.select("chip_id", "pos"), supplied(inp)).withColumn("kind", F.coalesce("kind", F.lit("none")))


@query("e3_missing_meta", "SELECT DISTINCT chip_id FROM fx_class WHERE chip_id NOT IN (SELECT item_id FROM benchmark)")
def e3_missing_meta(inp):
    return J.missing_meta(inp.fx_class, supplied(inp))


_TPL = "SELECT o_orderkey AS chip_id, k.class_id, o_orderkey*3+k.class_id AS template_pos FROM orders, (VALUES (1),(2),(3)) k(class_id)"


@query("e4_fill_template", f"SELECT chip_id, CAST(class_id AS BIGINT) AS class_id, template_pos, coalesce(rle,'') AS rle FROM ({_TPL}) t LEFT JOIN (SELECT l_orderkey AS chip_id, CAST(min(l_linenumber) AS INTEGER) AS class_id, CAST(count(*) AS VARCHAR)||' 1' AS rle FROM lineitem GROUP BY l_orderkey) r USING (chip_id, class_id)")
def e4_fill_template(inp):
    t = inp.orders.select(F.col("o_orderkey").alias("chip_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("class_id")).withColumn("template_pos", F.col("chip_id") * 3 + F.col("class_id"))
    r = inp.lineitem.groupBy(F.col("l_orderkey").alias("chip_id")).agg(F.min("l_linenumber").alias("class_id"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 1")).alias("rle"))
    return longs(J.fill_template(t, r))


def scenes(inp):
    """Scenes in the shape of the selection operators."""
    return inp.fx_scene.select(
        "scene_id", "task", F.when(F.col("task") == "af", F.col("t_post")).alias("observed_at"),
        F.expr("t_post - make_interval(0,0,0,cast(gap_days as int))").alias("date_pre"), F.col("t_post").alias("date_post"), "w", "s", "e", "n", "cloud_percent", "t_post",
    )


def requests(inp):
    start = F.to_timestamp_ntz(F.concat(F.col("start_year").cast("string"), F.lit("-01-01")))
    end = F.to_timestamp_ntz(F.concat((F.col("start_year") + 2).cast("string"), F.lit("-01-01")))
    return inp.fx_request.withColumnRenamed("as_", "as").withColumns({"start": start, "end": end})


_MEET = "s.w<=r.ae AND r.aw<=s.e AND s.s<=r.an AND r.as_<=s.n"
_SELECTED = f"""SELECT r.request_id, s.scene_id FROM fx_scene s JOIN fx_request r ON s.task=r.task AND {_MEET} WHERE s.t_post>=make_timestamp(r.start_year,1,1,0,0,0.0) AND s.t_post<make_timestamp(r.start_year+2,1,1,0,0,0.0) AND (s.task='af' OR s.gap_days>0)"""


@query("e5_select_scenes", _SELECTED)
def e5_select_scenes(inp):
    return X.select_scenes(scenes(inp), requests(inp), columns=("request_id", "scene_id"))


_TRAIN_VAL = """SELECT a.epsg, a.x_min AS tx, a.y_min AS ty, v.x_min AS vx, v.y_min AS vy FROM (SELECT DISTINCT epsg,x_min,y_min,x_max,y_max FROM fx_meta WHERE split='train') a JOIN (SELECT DISTINCT epsg,x_min,y_min,x_max,y_max FROM fx_meta WHERE split='val') v
 ON a.epsg=v.epsg AND least(a.x_max,v.x_max)>greatest(a.x_min,v.x_min) AND least(a.y_max,v.y_max)>greatest(a.y_min,v.y_min)"""


def grids(inp):
    meta = inp.fx_meta
    return X.split_grids(meta.drop("split"), meta.select("chip_id", "split"))


@query("e6_split_overlap", _TRAIN_VAL)
def e6_split_overlap(inp):
    pairs = X.split_overlap(grids(inp), 400.0)
    return pairs.select("epsg", F.col("train_x_min").alias("tx"), F.col("train_y_min").alias("ty"), F.col("val_x_min").alias("vx"), F.col("val_y_min").alias("vy"))


@query(
    "e6_overlap_report",
    f"""SELECT (SELECT count(*) FROM fx_meta) AS chips, (SELECT count(*) FROM (SELECT DISTINCT epsg,x_min,y_min FROM fx_meta WHERE split='train') q) AS train_unique_grids,
 (SELECT count(*) FROM (SELECT DISTINCT epsg,x_min,y_min FROM fx_meta WHERE split='val') q) AS validation_unique_grids,
 (SELECT count(*) FROM (SELECT epsg,x_min,y_min FROM fx_meta WHERE split='train' INTERSECT SELECT epsg,x_min,y_min FROM fx_meta WHERE split='val') q) AS exact_shared_grids,
 count(*) AS overlapping_pairs, count(DISTINCT (epsg,tx,ty)) AS affected_train_grids, count(DISTINCT (epsg,vx,vy)) AS affected_validation_grids, count(*)=0 AS passes FROM ({_TRAIN_VAL}) p""",
)
def e6_overlap_report(inp):
    meta = inp.fx_meta
    return X.overlap_report(meta.drop("split"), meta.select("chip_id", "split"), 400.0)


@query("e7_shared_grids", "SELECT epsg,x_min,y_min,x_max,y_max FROM fx_meta WHERE split='train' INTERSECT SELECT epsg,x_min,y_min,x_max,y_max FROM fx_meta WHERE split='val'")
def e7_shared_grids(inp):
    return X.shared_grids(grids(inp))


@query("j2_common_grids", "SELECT epsg, x_min, y_min FROM fx_meta WHERE kind='af' INTERSECT SELECT epsg, x_min, y_min FROM fx_meta WHERE kind='bs'")
def j2_common_grids(inp):
    m = inp.fx_meta
    return X.common_grids(m.where("kind = 'af'"), m.where("kind = 'bs'"))


@query("e8_missing_ids", "SELECT doc_id AS chip_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e8_missing_ids(inp):
    """Documents that nobody labelled."""
    return J.missing_ids(inp.documents.select(F.col("doc_id").alias("chip_id")), inp.labels.select(F.col("doc_id").alias("chip_id")))


@query("e9_requested_scenes", "SELECT o_orderkey AS scene_id, o_custkey AS chip_id FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def e9_requested_scenes(inp):
    sc = inp.orders.select(F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("chip_id"))
    return J.requested_scenes(sc, inp.events.select(F.col("user_id").alias("chip_id")))


@query("e10_with_candidates", f"SELECT chip_id, CAST(cand AS BIGINT) AS cand, {Q.r('w')} AS w, count(*) AS pixels, {Q.r('sum(CAST(t1 AS DOUBLE)*w)')} AS total FROM fx_pixel, (VALUES (0,0.0::DOUBLE),(1,0.25::DOUBLE),(2,1.0::DOUBLE)) g(cand,w) GROUP BY chip_id, cand, w")
def e10_with_candidates(inp):
    grid = [{"cand": i, "w": w} for i, w in enumerate((0.0, 0.25, 1.0))]
    wide = J.with_candidates(inp.fx_pixel.select("chip_id", "t1"), grid)
    return longs(rounded(wide.groupBy("chip_id", "cand", "w").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("t1").cast("double") * F.col("w")).alias("total"))))


_POINTS = "SELECT o_orderkey AS point_id, CAST((o_orderkey*31337)%35700 AS DOUBLE)/100-178.25 AS lon, CAST((o_orderkey*27644)%16600 AS DOUBLE)/100-83 AS lat FROM orders"
_EDGES = "SELECT aoi_id, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM fx_vertex WINDOW w AS (PARTITION BY aoi_id ORDER BY seq)"


def closed_edges(inp):
    unclosed = K.check_rings(inp.fx_vertex).where("problem = 'not closed'").select("aoi_id")
    return V.ring_edges(inp.fx_vertex.join(unclosed, "aoi_id", "left_anti"))


def points(inp):
    return inp.spark.sql(_POINTS.replace("FROM orders", "FROM {orders}"), orders=inp.orders)


@query(
    "e11_points_in_aoi",
    f"""SELECT point_id, aoi_id FROM (SELECT point_id, aoi_id, sum(CASE WHEN (y1>lat)<>(y2>lat) AND lon<(x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END)%2=1 AS odd,
 max(CASE WHEN (x2-x1)*(lat-y1)-(y2-y1)*(lon-x1)=0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2) AND lat BETWEEN least(y1,y2) AND greatest(y1,y2) THEN 1 ELSE 0 END)=1 AS edge
 FROM ({_POINTS}) p JOIN ({_EDGES}) e ON e.x2 IS NOT NULL AND e.aoi_id NOT IN {Q.UNCLOSED} JOIN (SELECT aoi_id AS id, min(lon) AS lo, max(lon) AS hi, min(lat) AS bo, max(lat) AS tp FROM fx_vertex GROUP BY aoi_id) b ON b.id=e.aoi_id AND lon BETWEEN lo AND hi AND lat BETWEEN bo AND tp
 GROUP BY point_id, aoi_id) q WHERE odd OR edge""",
)
def e11_points_in_aoi(inp):
    cover = cut_lineage(V.aoi_cover(closed_edges(inp), size=2.0))
    return V.points_in_cover(points(inp), cover, 2.0).select("point_id", "aoi_id")


def boxes(inp):
    return inp.fx_scene.select("scene_id", "w", "s", "e", "n")


_HIT = "greatest(0.0,greatest(least(x1,x2)-e,w-greatest(x1,x2)))=0 AND greatest(0.0,greatest(least(y1,y2)-n,s-greatest(y1,y2)))=0"


@query(
    "e12_footprints_intersecting",
    f"""WITH eb AS (SELECT * FROM ({_EDGES}) q WHERE x2 IS NOT NULL AND aoi_id NOT IN {Q.UNCLOSED}),
 c AS (SELECT scene_id, aoi_id, x1,y1,x2,y2,w,s,e,n, (x2-x1)*(s-y1)-(y2-y1)*(w-x1) AS k1, (x2-x1)*(s-y1)-(y2-y1)*(e-x1) AS k2, (x2-x1)*(n-y1)-(y2-y1)*(e-x1) AS k3, (x2-x1)*(n-y1)-(y2-y1)*(w-x1) AS k4
  FROM fx_scene JOIN eb ON {_HIT}),
 touch AS (SELECT DISTINCT scene_id, aoi_id FROM c WHERE NOT ((k1>0 AND k2>0 AND k3>0 AND k4>0) OR (k1<0 AND k2<0 AND k3<0 AND k4<0))),
 inside AS (SELECT scene_id, aoi_id FROM fx_scene sc JOIN (SELECT aoi_id AS id, min(lon) AS lo, max(lon) AS hi, min(lat) AS bo, max(lat) AS tp FROM fx_vertex GROUP BY aoi_id) b ON sc.w BETWEEN lo AND hi AND sc.s BETWEEN bo AND tp JOIN eb ON eb.aoi_id=b.id
  GROUP BY scene_id, aoi_id HAVING sum(CASE WHEN (y1>s)<>(y2>s) AND w<(x2-x1)*(s-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END)%2=1)
 SELECT scene_id, aoi_id FROM touch UNION SELECT scene_id, aoi_id FROM inside""",
)
def e12_footprints_intersecting(inp):
    edges = cut_lineage(closed_edges(inp))
    return V.boxes_meeting(boxes(inp), edges, cut_lineage(V.aoi_cover(edges, size=2.0)), "scene_id", size=2.0)


_BUNDLES = "SELECT c_custkey AS bundle_id, CASE WHEN c_custkey%50=0 THEN 'ready' ELSE 'unavailable' END AS status, CASE c_custkey%3 WHEN 0 THEN 'af' WHEN 1 THEN 'bs' ELSE 'af,bs' END AS tasks FROM customer"
_WANTS = "SELECT o_orderkey AS request_id, CASE o_custkey%3 WHEN 0 THEN 'af' WHEN 1 THEN 'bs' ELSE 'af,bs' END AS tasks FROM orders"


@query("e13_capable_bundles", f"SELECT request_id, bundle_id FROM ({_WANTS}) r JOIN ({_BUNDLES}) b ON b.status='ready' AND (r.tasks=b.tasks OR b.tasks='af,bs')")
def e13_capable_bundles(inp):
    b = inp.spark.sql(_BUNDLES.replace("FROM customer", "FROM {c}"), c=inp.customer).withColumn("tasks", F.split("tasks", ","))
    r = inp.spark.sql(_WANTS.replace("FROM orders", "FROM {o}"), o=inp.orders).withColumn("tasks", F.split("tasks", ","))
    return J.capable_bundles(r, b)


_OWNER = "CASE WHEN source_scene_id IS NOT NULL THEN source_scene_id||':'||strftime(observed_at,'%Y-%m-%d %H:%M:%S') ELSE scene_id END"
_DEDUP = f"""SELECT cell_owner, cell_row, cell_col, scene_id, {Q.r('score')} AS score FROM (SELECT {_OWNER} AS cell_owner, rw AS cell_row, cl AS cell_col, scene_id, cls, score,
 row_number() OVER (PARTITION BY source_scene_id IS NOT NULL, {_OWNER}, rw, cl ORDER BY least(rw+1,cl+1,40-rw,40-cl) DESC, scene_id, event_id) AS k FROM fx_hotspot WHERE valid AND (source_scene_id IS NOT NULL OR cls=1)) q WHERE k=1 AND cls=1"""


@query("i1_dedup_hotspots", _DEDUP.replace(f", {Q.r('score')} AS score", ""))
def i1_dedup_hotspots(inp):
    # one report per pixel: the first event of a (scene, cell) stands for it
    first = inp.fx_hotspot.where("valid").groupBy("source_scene_id", "grid_row_offset", "grid_col_offset", "scene_id", "observed_at", "rw", "cl", F.when(F.col("source_scene_id").isNull(), F.col("cls")).alias("_c")).agg(F.min_by(F.struct("cls", "score", "valid"), "event_id").alias("f"))
    px = first.select("source_scene_id", "grid_row_offset", "grid_col_offset", "scene_id", "observed_at", "rw", "cl", "f.*")
    won = N.dedup_hotspots(px, F.lit(40), F.lit(40))
    return won.select("cell_owner", "cell_row", "cell_col", "scene_id")


_CELLS = "SELECT 's'||CAST(chip_id AS VARCHAR(20)) AS scene_id, epsg, x_min/20+cl AS gx, y_max/20-1-rw AS gy, date_post, valid, cls FROM fx_class JOIN fx_meta USING (chip_id)"


@query("i2_mosaic_latest", f"SELECT epsg, gx, gy, scene_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY epsg, gx, gy ORDER BY date_post DESC, scene_id) AS k FROM ({_CELLS}) c WHERE valid) q WHERE k=1".replace("x_min/20", "x_min//20").replace("y_max/20", "y_max//20"))
def i2_mosaic_latest(inp):
    cells = inp.fx_class.join(inp.fx_meta, "chip_id").select(
        F.concat(F.lit("s"), F.col("chip_id").cast("string")).alias("scene_id"), "epsg", F.expr("x_min div 20 + cl").alias("gx"), F.expr("y_max div 20 - 1 - rw").alias("gy"), "date_post", "valid", "cls"
    )
    return N.mosaic_latest(cells).select("epsg", "gx", "gy", "scene_id", "cls")


@query("i3_top_chips", "SELECT chip_id, kind, richness, k AS rank FROM (SELECT chip_id, kind, CAST(rich AS BIGINT) AS richness, row_number() OVER (PARTITION BY kind ORDER BY rich DESC, chip_id) AS k FROM (SELECT *, CASE WHEN kind='af' THEN n_fire_px ELSE least(sev1_px,sev2_px,sev3_px) END AS rich FROM fx_meta WHERE split='val') m) q WHERE k<=2")
def i3_top_chips(inp):
    return longs(N.top_chips(inp.fx_meta).select("chip_id", "kind", "richness", "rank"))


def _search_sql(limit: str) -> str:
    return f"""SELECT request_id, scene_id, k AS rank, total>lim AS truncated FROM (SELECT request_id, scene_id, {limit} AS lim, row_number() OVER (PARTITION BY request_id ORDER BY t_post DESC, scene_id) AS k, count(*) OVER (PARTITION BY request_id) AS total
 FROM fx_scene s JOIN fx_request r ON {_MEET} WHERE t_post>=make_timestamp(start_year,1,1,0,0,0.0) AND t_post<make_timestamp(start_year+1,1,1,0,0,0.0) AND cloud_percent<=80) q WHERE k<=lim"""


def _search(inp, limit):
    sc = inp.fx_scene.select("scene_id", F.col("t_post").alias("acquired_at"), "cloud_percent", "w", "s", "e", "n")
    rq = inp.fx_request.withColumnRenamed("as_", "as").select(
        "request_id", "aw", "as", "ae", "an", F.to_timestamp_ntz(F.concat(F.col("start_year").cast("string"), F.lit("-01-01"))).alias("date_start"),
        F.to_date(F.concat(F.col("start_year").cast("string"), F.lit("-12-31"))).alias("date_end"), F.lit(80.0).alias("cloud_max"), limit.alias("max_results"),
    )
    return longs(N.search_scenes(sc, rq).select("request_id", "scene_id", "rank", "truncated"))


@query("i4_search_scenes", _search_sql("r.request_id%5+1"))
def i4_search_scenes(inp):
    return _search(inp, F.col("request_id") % 5 + 1)


@query("i4_search_scenes_wide", _search_sql("r.request_id%60+1"))
def i4_search_scenes_wide(inp):
    """Limits on both sides of 20: nothing but the request's own limit cuts."""
    return _search(inp, F.col("request_id") % 60 + 1)


@query("i7_order_features", "SELECT cell_owner, cell_row, cell_col FROM (SELECT scene_id AS cell_owner, rw AS cell_row, cl AS cell_col, row_number() OVER (ORDER BY scene_id) AS k FROM fx_hotspot WHERE valid AND cls=1) q")
def i7_order_features(inp):
    fires = inp.fx_hotspot.where("valid and cls = 1").select(F.col("scene_id").alias("cell_owner"), F.col("rw").alias("cell_row"), F.col("cl").alias("cell_col"))
    return N.order_features(fires)
