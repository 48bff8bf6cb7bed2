"""B: contracts; the views are bent so that every rule has offenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import decided, longs, rounded
from checks.q_metrics import DEC
from checks.registry import query
from ember.functions import text as X
from ember.operators import confusion as C
from ember.operators import contracts as K

_SPEC = {"viirs": ("I1", "I2", "I3", "I4", "I5"), "aux": ("landcover", "dem"), "s2_pre": ("B2", "B3")}
_CHIPS = """SELECT o_orderkey AS chip_id, CASE o_orderkey%4 WHEN 0 THEN 'viirs' WHEN 1 THEN 'aux' WHEN 2 THEN 's2_pre' ELSE 'odd' END AS key,
 CASE WHEN o_custkey%19=0 THEN 'dem,landcover' WHEN o_custkey%23=0 THEN 'I1' WHEN o_orderkey%4=0 THEN 'I1,I2,I3,I4,I5' WHEN o_orderkey%4=1 THEN 'landcover,dem' ELSE 'B2,B3' END AS names,
 CASE WHEN o_custkey%29=0 THEN 255 ELSE 256 END AS height, 256 AS width, CASE WHEN o_custkey%31=0 THEN 'int16' ELSE 'float32' END AS dtype FROM orders"""


@query(
    "b1_check_bands",
    f"""SELECT * FROM (SELECT chip_id, CASE WHEN want IS NULL THEN 'unknown source' WHEN len(string_split(names,','))<>len(string_split(want,',')) THEN 'band count' WHEN names<>want THEN 'band names' WHEN height<>256 THEN 'shape' WHEN dtype<>'float32' THEN 'dtype' END AS problem
 FROM (SELECT *, CASE key WHEN 'viirs' THEN 'I1,I2,I3,I4,I5' WHEN 'aux' THEN 'landcover,dem' WHEN 's2_pre' THEN 'B2,B3' END AS want FROM ({_CHIPS}) q) z) w WHERE problem IS NOT NULL""",
)
def b1_check_bands(inp):
    chips = inp.spark.sql(_CHIPS.replace("FROM orders", "FROM {orders}"), orders=inp.orders).withColumn("bands", F.split("names", ","))
    return K.check_bands(chips, _SPEC, dict.fromkeys(_SPEC, (256, 256)), dict.fromkeys(_SPEC, "float32")).select("chip_id", "problem")


_GRIDS = """SELECT CAST(floor(o_orderkey/3) AS BIGINT) AS chip_id, 256 AS width, 256 AS height, CASE WHEN o_custkey%37=0 THEN 32638 ELSE 32637 END AS epsg, CASE WHEN o_custkey%41=0 THEN 20.5 ELSE 20.0 END AS a FROM orders"""


@query("b2_check_grids", f"SELECT chip_id, count(DISTINCT (width, height, epsg, a)) AS n_grids FROM ({_GRIDS}) q GROUP BY chip_id HAVING n_grids>1")
def b2_check_grids(inp):
    grids = inp.spark.sql(_GRIDS.replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    return K.check_grids(grids, ["width", "height", "epsg", "a"])


@query("b3_check_domain", "SELECT chip_id, rw, cl, pre_SCL AS scl FROM fx_bs WHERE pre_SCL NOT IN (2,4,5,6,7,11)")
def b3_check_domain(inp):
    return K.check_domain(inp.fx_bs, "pre_SCL", [2, 4, 5, 6, 7, 11]).select("chip_id", "rw", "cl", F.col("pre_SCL").alias("scl"))


@query("b4_check_classes", f"SELECT chip_id, rw, cl FROM {DEC} d WHERE NOT valid OR pred NOT IN (0,1,2) OR truth=3")
def b4_check_classes(inp):
    px = decided(inp.fx_pixel).withColumn("truth", F.when(F.col("valid"), F.col("truth")).otherwise(255))
    return K.check_classes(px, [0, 1, 2]).select("chip_id", "rw", "cl")


@query("b5_set_diff", "SELECT o_custkey AS id, 'missing' AS side FROM (SELECT DISTINCT o_custkey FROM orders) o WHERE o_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'extra' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def b5_set_diff(inp):
    left = inp.orders.select(F.col("o_custkey").alias("id")).distinct()
    right = inp.events.select(F.col("user_id").alias("id")).distinct()
    return K.set_diff(left, right, "id")


@query("j1_missing_extra", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j1_missing_extra(inp):
    return K.set_diff(inp.documents.select("doc_id"), inp.labels.select("doc_id"), "doc_id")


@query("b6_check_unique", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING n>1")
def b6_check_unique(inp):
    return longs(K.check_unique(inp.lineitem, ["l_orderkey", "l_linenumber"]))


_RECORDS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 THEN 'af' WHEN o_orderkey%3=1 THEN 'bs' ELSE 'xx' END AS task, CASE WHEN o_custkey%43=0 THEN 4 ELSE 3 END AS channels,
 CASE WHEN o_custkey%13=0 THEN '' WHEN o_custkey%17=0 THEN 'a,a,b' WHEN o_custkey%19=0 THEN 'b,a,c' ELSE 'a,b,c' END AS names FROM orders"""


@query(
    "b7_check_feature_order",
    f"""SELECT * FROM (SELECT id, task, CASE WHEN names='' THEN 'no names' WHEN names='a,a,b' THEN 'repeated names' WHEN channels<>3 THEN 'channel count' WHEN task='xx' OR names<>CASE task WHEN 'af' THEN 'a,b,c' ELSE 'b,a,c' END THEN 'order differs from model' END AS problem FROM ({_RECORDS}) q) z WHERE problem IS NOT NULL""",
)
def b7_check_feature_order(inp):
    rec = inp.spark.sql(_RECORDS.replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    rec = rec.withColumn("feature_names", F.when(F.col("names") != "", F.split("names", ",")))
    # the model's contract: one row per task
    model = rec.where("task in ('af', 'bs')").select("task").distinct().withColumn("model_names", F.split(F.when(F.col("task") == "af", "a,b,c").otherwise("b,a,c"), ","))
    return K.check_feature_order(rec, model)


_BENT = "SELECT chip_id, rw, cl, valid, CASE WHEN pos%97=5 THEN CAST('NaN' AS FLOAT) WHEN pos%101=7 THEN t0+CAST(1 AS FLOAT) ELSE t0 END AS t0, t1, t2, t3, CASE WHEN pos%89=3 THEN 9 ELSE truth END AS truth FROM fx_pixel"


@query("b8_check_probs", f"SELECT * FROM (SELECT chip_id, rw, cl, CASE WHEN isnan(t0) OR t0>1.000001 OR t0<-0.000001 THEN 'score' WHEN valid AND truth=9 THEN 'label' END AS problem FROM ({_BENT}) q) z WHERE problem IS NOT NULL")
def b8_check_probs(inp):
    bent = inp.spark.sql(_BENT.replace("FROM fx_pixel", "FROM {p}"), p=inp.fx_pixel)
    return K.check_probs(bent, ["t0", "t1", "t2", "t3"], [0, 1, 2, 3], 1e-6).select("chip_id", "rw", "cl", "problem")


_OTHER = "SELECT chip_id, rw, cl, CASE WHEN pos%71=1 THEN 0 ELSE truth END AS truth, CASE WHEN pos%73=2 THEN NOT valid ELSE valid END AS valid FROM fx_pixel WHERE pos%79<>3"


@query(
    "b9_check_aligned",
    f"""SELECT * FROM (SELECT chip_id, rw, cl, CASE WHEN o.truth IS NULL THEN 'only in a' WHEN a.truth<>o.truth THEN 'truth differs' WHEN a.valid<>o.valid THEN 'valid differs' END AS problem FROM fx_pixel a LEFT JOIN ({_OTHER}) o USING (chip_id, rw, cl)) q WHERE problem IS NOT NULL""",
)
def b9_check_aligned(inp):
    return K.check_aligned(inp.fx_pixel, inp.spark.sql(_OTHER.replace("FROM fx_pixel", "FROM {p}"), p=inp.fx_pixel))


@query(
    "b10_check_metrics",
    f"""WITH a AS (UNPIVOT ({Q.score_select(DEC + ' d', 'chip_id', rounded=False)}) ON IoU_burn, IoU_1, IoU_2, IoU_3, mIoU_sev, score INTO NAME metric VALUE value),
 e AS (UNPIVOT ({Q.score_select(Q.decided(1.0, (1, 1, 1, 1)) + ' d', 'chip_id', rounded=False)}) ON IoU_burn, IoU_1, IoU_2, IoU_3, mIoU_sev, score INTO NAME metric VALUE value)
 SELECT chip_id, metric, {Q.r('a.value')} AS actual, {Q.r('e.value')} AS expected FROM a JOIN e USING (chip_id, metric) WHERE abs(a.value-e.value)>0.1""",
)
def b10_check_metrics(inp):
    def long(px):
        scored = C.score_wide(C.confusion_wide(px, ["chip_id"]), ["chip_id"])
        rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("IoU_burn", "IoU_1", "IoU_2", "IoU_3", "mIoU_sev", "score")])
        return scored.select("chip_id", F.inline(rows))

    actual, expected = long(decided(inp.fx_pixel)), long(decided(inp.fx_pixel, 1.0, (1, 1, 1, 1)))
    return rounded(K.check_metrics(actual, expected, 0.1, ["chip_id", "metric"]))


_BOX = "SELECT o_orderkey AS id, CASE WHEN o_custkey%53=0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_custkey%400 AS DOUBLE)-200 END AS w, CAST(o_orderkey%190 AS DOUBLE)-95 AS s, CAST(o_custkey%380 AS DOUBLE)-190 AS e, CAST(o_orderkey%170 AS DOUBLE)-85 AS n FROM orders"


@query("b11_valid_bbox", f"SELECT id FROM ({_BOX}) q WHERE NOT (NOT isnan(w) AND w>=-180 AND w<e AND e<=180 AND s>=-90 AND s<n AND n<=90)")
def b11_valid_bbox(inp):
    return K.check_bbox(inp.spark.sql(_BOX.replace("FROM orders", "FROM {orders}"), orders=inp.orders)).select("id")


@query(
    "b12_check_rings",
    """WITH s AS (SELECT aoi_id, part, ring, count(*) AS n_vertices, arg_min(lon,seq)=arg_max(lon,seq) AND arg_min(lat,seq)=arg_max(lat,seq) AS closed, max(CASE WHEN lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 THEN 0 ELSE 1 END) AS outside FROM fx_vertex GROUP BY aoi_id, part, ring),
 a AS (SELECT aoi_id, part, ring, abs(sum(x*ny-nx*y))/2 AS area FROM (SELECT aoi_id, part, ring, lon-first_value(lon) OVER w AS x, lat-first_value(lat) OVER w AS y, lead(lon) OVER w-first_value(lon) OVER w AS nx, lead(lat) OVER w-first_value(lat) OVER w AS ny FROM fx_vertex WINDOW w AS (PARTITION BY aoi_id, part, ring ORDER BY seq)) t GROUP BY aoi_id, part, ring)
 SELECT * FROM (SELECT aoi_id, CAST(part AS BIGINT) AS part, CAST(ring AS BIGINT) AS ring, n_vertices, CASE WHEN n_vertices<4 THEN 'too few positions' WHEN NOT closed THEN 'not closed' WHEN outside=1 THEN 'outside WGS84' WHEN n_vertices>10000 THEN 'too many vertices' WHEN area=0 THEN 'zero area' END AS problem FROM s JOIN a USING (aoi_id, part, ring)) q WHERE problem IS NOT NULL""",
)
def b12_check_rings(inp):
    return longs(K.check_rings(inp.fx_vertex))


def _cross(a: str, b: str, p: str) -> str:
    return f"(({b}.lon-{a}.lon)*({p}.lat-{a}.lat)-({b}.lat-{a}.lat)*({p}.lon-{a}.lon))"


def _within(a: str, b: str, p: str) -> str:
    return f"({p}.lon BETWEEN least({a}.lon,{b}.lon) AND greatest({a}.lon,{b}.lon) AND {p}.lat BETWEEN least({a}.lat,{b}.lat) AND greatest({a}.lat,{b}.lat))"


_C = [_cross("a", "a2", "b"), _cross("a", "a2", "b2"), _cross("b", "b2", "a"), _cross("b", "b2", "a2")]


@query(
    "b13_ring_self_intersections",
    f"""WITH v AS (SELECT aoi_id, seq, lon, lat FROM {Q.OPEN_RINGS} w),
 bad AS (SELECT DISTINCT a.aoi_id FROM v a JOIN v a2 ON a2.aoi_id=a.aoi_id AND a2.seq=(a.seq+1)%6 JOIN v b ON b.aoi_id=a.aoi_id AND b.seq>a.seq+1 AND NOT (a.seq=0 AND b.seq=5) JOIN v b2 ON b2.aoi_id=a.aoi_id AND b2.seq=(b.seq+1)%6
  WHERE (sign({_C[0]})*sign({_C[1]})<0 AND sign({_C[2]})*sign({_C[3]})<0) OR ({_C[0]}=0 AND {_within('a', 'a2', 'b')}) OR ({_C[1]}=0 AND {_within('a', 'a2', 'b2')}) OR ({_C[2]}=0 AND {_within('b', 'b2', 'a')}) OR ({_C[3]}=0 AND {_within('b', 'b2', 'a2')}))
 SELECT aoi_id, 'self-intersection' AS problem FROM bad""",
)
def b13_ring_self_intersections(inp):
    return K.ring_self_intersections(K.strip_closing(inp.fx_vertex))


_PERIOD = "SELECT o_orderkey AS id, CASE WHEN o_custkey%47=0 THEN NULL ELSE o_orderdate END AS start_at, CASE WHEN o_custkey%5=0 THEN o_orderdate ELSE o_orderdate+INTERVAL 3 DAY END AS end_at FROM orders"


@query("b14_norm_period", f"SELECT id FROM ({_PERIOD}) q WHERE start_at IS NULL OR start_at>=end_at")
def b14_norm_period(inp):
    df = inp.spark.sql(_PERIOD.replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    return K.check_periods(df, "start_at", "end_at").select("id")


@query(
    "b15_days_period",
    "SELECT o_orderkey AS id, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS p_start, strftime(o_orderdate+INTERVAL 1 DAY*(o_custkey%10+1),'%Y-%m-%d %H:%M:%S') AS p_end, strftime(o_orderdate,'%Y-%m-%d') AS d_start, strftime(o_orderdate+INTERVAL 1 DAY*(o_custkey%10),'%Y-%m-%d') AS d_end FROM orders",
)
def b15_days_period(inp):
    days = inp.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 10).cast("int")).alias("b"))
    start, end = X.days_to_period(F.col("a"), F.col("b"))
    half_open = days.select("id", start.alias("s"), end.alias("e"))
    d1, d2 = X.period_to_days(F.col("s"), F.col("e"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return half_open.select("id", F.date_format("s", fmt).alias("p_start"), F.date_format("e", fmt).alias("p_end"), d1.cast("string").alias("d_start"), d2.cast("string").alias("d_end"))


_SEARCH = """SELECT o_orderkey AS id, CAST(o_custkey%340 AS DOUBLE)-170 AS w, CAST(o_orderkey%176 AS DOUBLE)-88 AS s, CAST(o_custkey%340 AS DOUBLE)-170+CAST(o_orderkey%7 AS DOUBLE)/2+CAST(0.1 AS DOUBLE) AS e,
 CAST(o_orderkey%176 AS DOUBLE)-88+CAST(o_custkey%5 AS DOUBLE)/2+CAST(0.1 AS DOUBLE) AS n, o_custkey%1100 AS n_positions, o_orderkey%400 AS days, CAST(o_custkey%107 AS DOUBLE) AS cloud_max, o_orderkey%23 AS max_results FROM orders"""
_EA = 6378137.0
_K0 = "(cos(radians(30))/sqrt(1-0.0066943799901413165*pow(sin(radians(30)),2)))"


def _cx(lon: str) -> str:
    return f"({_EA}*{_K0}*radians({lon}))"


def _cy(lat: str) -> str:
    e = "0.08181919084262149"
    s = f"sin(radians({lat}))"
    return f"({_EA}/(2*{_K0})*(1-0.0066943799901413165)*({s}/(1-0.0066943799901413165*{s}*{s})-1/(2*{e})*ln((1-{e}*{s})/(1+{e}*{s}))))"


@query(
    "b16_check_search_limits",
    f"""SELECT id, problem FROM (SELECT id, CASE WHEN e-w>180 OR s<-85 OR n>85 THEN 'polar or antimeridian' WHEN abs({_cx('e')}-{_cx('w')})*abs({_cy('n')}-{_cy('s')})/1e6>25000 OR greatest(abs({_cx('e')}-{_cx('w')}),abs({_cy('n')}-{_cy('s')}))>300000 THEN 'area'
 WHEN n_positions>1000 THEN 'positions' WHEN days>366 OR days<1 THEN 'days' WHEN cloud_max>100 THEN 'cloud' WHEN max_results<1 OR max_results>20 THEN 'limit' END AS problem FROM ({_SEARCH}) q) z WHERE problem IS NOT NULL""",
)
def b16_check_search_limits(inp):
    df = inp.spark.sql(_SEARCH.replace("FROM orders", "FROM {orders}"), orders=inp.orders).withColumnRenamed("max_results", "limit")
    return K.check_search_limits(df).select("id", "problem")


_REC = "SELECT o_orderkey AS id, CASE WHEN o_custkey%7=0 THEN 1.5 WHEN o_custkey%11=0 THEN NULL ELSE 0.25 END AS tree_weight, CASE WHEN o_custkey%5=0 THEN -1.0 ELSE 1.3 END AS m2, o_custkey%13=0 AS short FROM orders"


@query("b17_check_recipe", f"SELECT id, CASE WHEN tree_weight IS NULL OR tree_weight>1 THEN 'weight' ELSE 'multipliers' END AS problem FROM ({_REC}) q WHERE tree_weight IS NULL OR tree_weight>1 OR m2<=0 OR short")
def b17_check_recipe(inp):
    df = inp.spark.sql(_REC.replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    m = [F.lit(1.0), F.lit(2.0), F.col("m2").cast("double"), F.lit(1.0)]
    df = df.withColumns({"tree_weight": F.col("tree_weight").cast("double"), "class_multipliers": F.when(F.col("short"), F.array(*m[:3])).otherwise(F.array(*m))})
    return K.check_recipe(df).select("id", "problem")


_TRAIN = """SELECT o_orderkey AS id, CASE o_custkey%9 WHEN 0 THEN '{"mode":"demo","source":{"split":"validation"}}' WHEN 1 THEN '{"label":"train set","source":{"name":"public"}}'
 WHEN 2 THEN '{"dataset":"public train"}' WHEN 3 THEN '{"provenance":["x",["y","Training"]]}' WHEN 4 THEN '{"source":{"a":{"note":"train"}}}' WHEN 5 THEN '"val"'
 WHEN 6 THEN '{"train":1,"split":{"validation":["test"]}}' WHEN 7 THEN '[]' ELSE '{"source":{"name":"retrained"},"note":"valid"}' END AS doc FROM orders"""


# keys are stripped before the words are looked for
@query("b18_is_training", f"""SELECT id, regexp_matches(regexp_replace(doc, '"[^"]*" *:', '', 'g'), '(?i)\\b(train|training|validation|val)\\b') AS training FROM ({_TRAIN}) q""")
def b18_is_training(inp):
    from ember.sources.manifests import is_training

    docs = inp.spark.sql(_TRAIN.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    return docs.select("id", is_training(F.col("doc")).alias("training"))


_MODULES = """SELECT aoi_id AS request_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n, 2+CASE WHEN aoi_id%7=0 THEN 1 ELSE 0 END AS hotspot_count, 1.0 AS area_1, 2.0 AS area_2, 3.0+CASE WHEN aoi_id%11=0 THEN 1 ELSE 0 END AS area_3,
 6.0+CASE WHEN aoi_id%11=0 THEN 1 ELSE 0 END+CASE WHEN aoi_id%19=0 THEN 1 ELSE 0 END AS burn_area_ha, CASE WHEN aoi_id%23=0 THEN 1.5 ELSE 0.5 END AS coverage_fraction FROM fx_vertex GROUP BY aoi_id"""


@query(
    "b19_check_geo_products",
    """SELECT c_custkey AS request_id, problem FROM customer, (VALUES ('hotspot count'),('hotspot outside'),('repeated hotspot'),('class area'),('burn total'),('coverage')) p(problem)
 WHERE CASE problem WHEN 'hotspot count' THEN c_custkey%7=0 WHEN 'hotspot outside' THEN c_custkey%5=0 WHEN 'repeated hotspot' THEN c_custkey%3=0 WHEN 'class area' THEN c_custkey%11=0 WHEN 'burn total' THEN c_custkey%19=0 ELSE c_custkey%23=0 END""",
)
def b19_check_geo_products(inp):
    sql = _MODULES.replace("FROM fx_vertex", "FROM {v}")
    modules = inp.spark.sql(sql, v=inp.fx_vertex)
    modules = modules.withColumns({c: F.col(c).cast("double") for c in ("area_1", "area_2", "area_3", "burn_area_ha", "coverage_fraction")})
    centre = modules.select("request_id", ((F.col("w") + F.col("e")) / 2).alias("lon"), ((F.col("s") + F.col("n")) / 2).alias("lat"))
    first = centre.withColumn("hotspot_id", F.lit("a")).withColumn("lat", F.when(F.col("request_id") % 5 == 0, F.col("lat") + 90).otherwise(F.col("lat")))
    second = centre.withColumn("hotspot_id", F.when(F.col("request_id") % 3 == 0, "a").otherwise("b"))
    contours = modules.select("request_id", F.inline(F.array(*[F.struct(F.lit(c).alias("class_id"), F.lit(float(c)).alias("area_ha")) for c in (1, 2, 3)])))
    return K.check_geo_products(modules, first.unionByName(second), contours)


_PAIR = "SELECT chip_id, rw, cl FROM fx_pixel WHERE chip_id%7<>3 AND NOT (chip_id%5=2 AND rw=14)"


@query("b20_check_pairs", "SELECT DISTINCT chip_id, CASE WHEN chip_id%7=3 THEN 'no prediction' ELSE 'shape' END AS problem FROM fx_pixel WHERE chip_id%7=3 OR chip_id%5=2")
def b20_check_pairs(inp):
    return K.check_pairs(inp.fx_pixel, inp.spark.sql(_PAIR.replace("FROM fx_pixel", "FROM {p}"), p=inp.fx_pixel))


