"""A and M: listings, manifests, sinks and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlbits as Q
from checks.common import longs, rounded
from checks.q_rle import _SUBMISSION, sub_px, template
from checks.registry import query
from ember.functions import text as X
from ember.operators.submission import build_submission
from ember.session import scratch
from ember.sources import assets as A
from ember.sources import manifests as M
from ember.sources import sinks as S


def on(inp, sql: str, table: str):
    """Run portable SQL over one given table (braces in texts are kept)."""
    safe = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {t}")
    return inp.spark.sql(safe, t=getattr(inp, table))


_FILES = """SELECT o_orderkey AS id, 'root/'||CASE o_custkey%4 WHEN 0 THEN 'af/viirs/' ELSE 'bs/x/' END||CASE WHEN o_custkey%4=0 THEN 'AF_' WHEN o_custkey%4=3 THEN 'XX_' ELSE 'BS_' END||CAST(CAST(floor(o_orderkey/6) AS BIGINT) AS VARCHAR(20))||
 CASE o_orderkey%6 WHEN 0 THEN '_VIIRS_I1-I5.tif' WHEN 1 THEN '_AUX.tif' WHEN 2 THEN '_Sentinel-2_pre.tif' WHEN 3 THEN '_Sentinel-2_post.tif' WHEN 4 THEN '_MASK.tif' ELSE '_Sentinel-1_pre.tif' END AS path FROM orders"""
_STEM = "regexp_extract(path, '([^/]*)_(VIIRS_I1-I5|AUX|Sentinel-2_pre|Sentinel-2_post|Sentinel-1_pre|Sentinel-1_post)\\.tif$', 1)"
_KIND = "regexp_extract(path, '_(VIIRS_I1-I5|AUX|Sentinel-2_pre|Sentinel-2_post|Sentinel-1_pre|Sentinel-1_post)\\.tif$', 1)"
_ASSETS = f"""(SELECT chip_id, CASE k WHEN 'VIIRS_I1-I5' THEN 'viirs' WHEN 'AUX' THEN 'aux' WHEN 'Sentinel-2_pre' THEN 's2_pre' WHEN 'Sentinel-2_post' THEN 's2_post' ELSE 's1_pre' END AS key, path FROM (SELECT {_STEM} AS chip_id, {_KIND} AS k, path FROM ({_FILES}) f) q WHERE regexp_full_match(chip_id, '(AF|BS)_[A-Za-z0-9_-]+'))"""


@query("a1_asset_table", f"SELECT * FROM {_ASSETS} a")
def a1_asset_table(inp):
    return A.asset_table(on(inp, _FILES, "orders"))


@query("a1_duplicate_assets", f"SELECT chip_id, key, count(*) AS n FROM (SELECT * FROM {_ASSETS} a UNION ALL SELECT * FROM {_ASSETS} b WHERE key='aux') q GROUP BY chip_id, key HAVING n>1")
def a1_duplicate_assets(inp):
    t = A.asset_table(on(inp, _FILES, "orders"))
    return A.duplicate_assets(t.unionByName(t.where("key = 'aux'")))


@query("a2_asset_map", f"SELECT chip_id, string_agg(key||'='||path, ',' ORDER BY key) AS assets FROM {_ASSETS} a GROUP BY chip_id")
def a2_asset_map(inp):
    m = A.asset_map(A.asset_table(on(inp, _FILES, "orders")))
    return m.select("chip_id", F.array_join(F.transform(F.array_sort(F.map_entries("assets")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("assets"))


@query(
    "a3_asset_inventory",
    f"""SELECT c.chip_id, lower(substr(c.chip_id,1,2)) AS task, coalesce(string_agg(CASE WHEN a.key IS NULL THEN w.key END, ',' ORDER BY w.key),'') AS missing FROM (SELECT DISTINCT chip_id FROM {_ASSETS} a) c
 JOIN (VALUES ('AF','aux'),('AF','mask'),('AF','viirs'),('BS','aux'),('BS','mask'),('BS','s1_post'),('BS','s1_pre'),('BS','s2_post'),('BS','s2_pre')) w(t,key) ON w.t=substr(c.chip_id,1,2) LEFT JOIN {_ASSETS} a ON a.chip_id=c.chip_id AND a.key=w.key GROUP BY c.chip_id""",
)
def a3_asset_inventory(inp):
    return A.asset_inventory(A.asset_table(on(inp, _FILES, "orders"))).withColumn("missing", F.array_join("missing", ","))


_LISTING = "SELECT CASE WHEN o_custkey%17=0 THEN '../' WHEN o_custkey%19=0 THEN '/abs/' ELSE 'data/' END||CAST(CAST(floor(o_orderkey/2) AS BIGINT)*2-o_orderkey%2*(o_custkey%2) AS VARCHAR(20)) AS member FROM orders"
_EXPECTED = "SELECT 'data/'||CAST(o_orderkey AS VARCHAR(20)) AS member FROM orders"


@query(
    "a4_member_audit",
    f"""WITH l AS ({_LISTING}), e AS ({_EXPECTED}) SELECT member, 'unsafe' AS problem FROM l WHERE member NOT LIKE 'data/%' UNION ALL SELECT member, 'repeated' FROM l GROUP BY member HAVING count(*)>1
 UNION ALL SELECT member, 'missing' FROM e WHERE member NOT IN (SELECT member FROM l) UNION ALL SELECT DISTINCT member, 'unexpected' FROM l WHERE member NOT IN (SELECT member FROM e)""",
)
def a4_member_audit(inp):
    return A.member_audit(on(inp, _LISTING, "orders"), on(inp, _EXPECTED, "orders"), "data/")


_META = "SELECT CAST(chip_id AS VARCHAR) AS chip_id, kind, CAST(epsg AS VARCHAR)||'.0' AS epsg, CAST(x_min AS DOUBLE) AS x_min, cloud_frac, n_fire_px FROM fx_meta"


@query("a7_read_chip_meta", f"SELECT chip_id, kind, CAST(substr(epsg,1,5) AS BIGINT) AS epsg, {Q.r('x_min')} AS x_min, {Q.r('cloud_frac')} AS cloud_frac, CAST(n_fire_px AS BIGINT) AS n_fire_px FROM ({_META}) q")
def a7_read_chip_meta(inp):
    path = scratch(inp.spark, "meta")
    m = inp.fx_meta
    columns = [m.chip_id.cast("string").alias("chip_id"), "kind", F.concat(m.epsg.cast("string"), F.lit(".0")).alias("epsg"), m.x_min.cast("double").alias("x_min"), "cloud_frac", m.n_fire_px.cast("bigint").alias("n_fire_px")]
    m.select(*columns).write.csv(path, header=True)
    back = M.read_chip_meta(inp.spark, path, "chip_id string, kind string, epsg string, x_min double, cloud_frac double, n_fire_px bigint")
    return longs(rounded(back.withColumn("epsg", X.epsg_code(F.col("epsg")))))


_RECORDS = """SELECT o_orderkey AS k, '{"records":[{"id":"r'||CAST(o_orderkey-o_custkey%2*(o_orderkey%2) AS VARCHAR(20))||'","task":"'||CASE WHEN o_custkey%31=0 THEN 'zz' ELSE 'af' END||'","split":"'||CASE WHEN o_custkey%5=0 THEN 'val' ELSE 'train' END||'","x_path":"x'||CAST(CAST(floor(o_orderkey/2) AS BIGINT) AS VARCHAR(20))||'","y_path":"y'||CAST(o_orderkey AS VARCHAR(20))||'"}]}' AS json FROM orders"""


@query(
    "a8_record_violations",
    """WITH r AS (SELECT 'r'||CAST(o_orderkey-o_custkey%2*(o_orderkey%2) AS VARCHAR) AS id, o_custkey%31=0 AS bad, o_custkey%5=0 AS val, 'x'||CAST(o_orderkey//2 AS VARCHAR) AS x FROM orders)
 SELECT id AS item, 'task or split' AS problem FROM r WHERE bad UNION ALL SELECT id, 'repeated id' FROM r GROUP BY id HAVING count(*)>1 UNION ALL SELECT x, 'path in both splits' FROM r GROUP BY x HAVING count(DISTINCT val)>1""",
)
def a8_record_violations(inp):
    return M.record_violations(M.parse_records(on(inp, _RECORDS, "orders")))


_SPLITS = """SELECT o_orderkey AS k, CASE o_custkey%3 WHEN 0 THEN '{"c'||CAST(o_orderkey AS VARCHAR(20))||'":"train"}' WHEN 1 THEN '{"split":{"c'||CAST(o_orderkey AS VARCHAR(20))||'":{"split":"val","g":1}}}' ELSE '{"assignments":{"c'||CAST(o_orderkey AS VARCHAR(20))||'":"odd"}}' END AS json FROM orders"""


@query("a9_read_split", "SELECT 'c'||CAST(o_orderkey AS VARCHAR) AS chip_id, CASE o_custkey%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'odd' END AS split FROM orders")
def a9_read_split(inp):
    return M.parse_split(on(inp, _SPLITS, "orders"))


_SCENES = """SELECT o_orderkey AS k, CASE o_custkey%4 WHEN 0 THEN '{"dataset_id":"d'||CAST(o_orderkey AS VARCHAR(20))||'","scenes":[{"scene_id":"s1","task":"af","observed_at":"2024-07-01T00:00:00Z"},{"scene_id":"s2","task":"bs"}]}'
 WHEN 1 THEN '{"dataset_id":"d'||CAST(o_orderkey AS VARCHAR(20))||'","mode":"other","scenes":[{"scene_id":"s1","task":"af"}]}' WHEN 2 THEN '{"scenes":[{"scene_id":"s1"}]}' ELSE 'not json' END AS json FROM orders"""


@query("a10_read_scenes", "SELECT 'd'||CAST(o_orderkey AS VARCHAR) AS dataset_id, s AS scene_id, CASE s WHEN 's1' THEN 'af' ELSE 'bs' END AS task, CASE s WHEN 's1' THEN '2024-07-01T00:00:00Z' ELSE '' END AS observed_at FROM orders, (VALUES ('s1'),('s2')) v(s) WHERE o_custkey%4=0")
def a10_read_scenes(inp):
    return M.parse_scenes(on(inp, _SCENES, "orders")).select("dataset_id", "scene_id", "task", F.coalesce("observed_at", F.lit("")).alias("observed_at"))


@query("a11_write_features", "SELECT task, split, count(*) AS pixels, count(DISTINCT chip_id) AS chips FROM fx_class JOIN (SELECT chip_id, split FROM fx_meta) m USING (chip_id) GROUP BY task, split")
def a11_write_features(inp):
    path = scratch(inp.spark, "features")
    S.write_features(inp.fx_class.join(inp.fx_meta.select("chip_id", "split"), "chip_id"), path)
    return S.feature_counts(inp.spark, path)


@query("a12_read_probs", f"SELECT chip_id, rw, cl, {Q.r('t1')} AS t1, truth FROM fx_pixel WHERE task='bs'")
def a12_read_probs(inp):
    path = scratch(inp.spark, "probs")
    S.write_probs(inp.fx_pixel.select("task", "chip_id", "rw", "cl", "t1", "truth"), path)
    return rounded(S.read_probs(inp.spark, path, "bs").select("chip_id", "rw", "cl", "t1", "truth"))


@query("a13_write_submission", f"SELECT chip_id, CAST(class_id AS BIGINT) AS class_id, rle FROM {_SUBMISSION} s")
def a13_write_submission(inp):
    path = scratch(inp.spark, "submission")
    S.write_submission(build_submission(template(inp), sub_px(inp)), path)
    return longs(S.read_submission(inp.spark, path))


@query("a14_write_geojson", """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":['||CAST(rw AS VARCHAR)||','||CAST(cl AS VARCHAR)||']},"properties":{"event_id":'||CAST(event_id AS VARCHAR)||',"scene_id":"'||scene_id||'"}}' AS value FROM fx_hotspot WHERE valid AND cls=1""")
def a14_write_geojson(inp):
    path = scratch(inp.spark, "geojson")
    fires = inp.fx_hotspot.where("valid and cls = 1").withColumn("point", F.struct(F.lit("Point").alias("type"), F.array("rw", "cl").alias("coordinates")))
    S.write_geojson(S.geojson_features(fires, "point", ["event_id", "scene_id"]), path)
    return inp.spark.read.text(path)


@query("a15_write_summary", """SELECT '{"id":'||CAST(o_orderkey AS VARCHAR)||',"area":'||CASE WHEN o_custkey%7=0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR)||'.0' END||'}' AS value FROM orders""")
def a15_write_summary(inp):
    path = scratch(inp.spark, "summary")
    area = F.when(F.col("o_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double"))
    S.write_summary(inp.orders.select(F.col("o_orderkey").alias("id"), area.alias("area")), path)
    return inp.spark.read.text(path)


@query("a17_checksum_audit", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id%7=0 THEN 'corrupt' WHEN doc_id%11=0 THEN 'missing' ELSE 'ok' END AS state FROM documents")
def a17_checksum_audit(inp):
    d = inp.documents.select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    got = d.where((F.col("doc_id") % 11 != 0) | (F.col("doc_id") % 7 == 0)).withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.col("sha256")))
    return A.checksum_audit(d.select("name", F.upper("sha256").alias("sha256")), got)


@query("a18_source_lock", "SELECT page_id AS id, regexp_replace(regexp_replace(url,'[?#].*$',''),'^HTTP','http') AS source_url, url LIKE '%?_%' OR url LIKE '%#_%' AS url_redacted FROM pages")
def a18_source_lock(inp):
    return A.source_lock(inp.pages.select(F.col("page_id").alias("id"), "url"), F.col("url")).select("id", "source_url", "url_redacted")


@query(
    "a20_build_scenes",
    """SELECT 's'||CAST(chip_id AS VARCHAR) AS scene_id, kind AS task, CASE WHEN kind='af' THEN 'af/viirs/s'||CAST(chip_id AS VARCHAR)||'_VIIRS_I1-I5.tif' ELSE 'bs/sentinel2_post/s'||CAST(chip_id AS VARCHAR)||'_Sentinel-2_post.tif' END AS reference_raster,
 strftime(CASE WHEN kind='af' THEN acquired_at ELSE date_pre END,'%Y-%m-%d %H:%M:%S') AS period_start, strftime(CASE WHEN kind='af' THEN acquired_at+INTERVAL 1 SECOND ELSE date_post+INTERVAL 1 DAY END,'%Y-%m-%d %H:%M:%S') AS period_end FROM fx_meta""",
)
def a20_build_scenes(inp):
    meta = inp.fx_meta.withColumn("chip_id", F.concat(F.lit("s"), F.col("chip_id").cast("string")))
    out = M.build_scenes(meta)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.select("scene_id", "task", "reference_raster", F.date_format("period_start", fmt).alias("period_start"), F.date_format("period_end", fmt).alias("period_end"))


_BUNDLE = """SELECT o_orderkey AS k, '{"bundle_id":"b'||CAST(o_orderkey AS VARCHAR(20))||'","tasks":{"af":{"path":"m","sha256":{"a.txt":"'||CASE WHEN o_custkey%3=0 THEN 'FF' ELSE 'aa' END||'"}},"bs":{"components":{"t":{"path":"m","sha256":{"a.txt":"aa","b.txt":"bb"}}}}}}' AS json FROM orders"""


@query("a21_manifest_files", "SELECT 'b'||CAST(o_orderkey AS VARCHAR) AS bundle_id, 'm' AS path, f AS file, CASE k WHEN 0 THEN CASE WHEN o_custkey%3=0 THEN 'ff' ELSE 'aa' END WHEN 1 THEN 'aa' ELSE 'bb' END AS sha256 FROM orders, (VALUES (0,'a.txt'),(1,'a.txt'),(2,'b.txt')) v(k,f)")
def a21_manifest_files(inp):
    return M.manifest_files(on(inp, _BUNDLE, "orders"))


@query("a21_conflicting_hashes", "SELECT 'b'||CAST(o_orderkey AS VARCHAR) AS bundle_id, 'm' AS path, 'a.txt' AS file, CAST(2 AS BIGINT) AS n FROM orders WHERE o_custkey%3=0")
def a21_conflicting_hashes(inp):
    return M.conflicting_hashes(M.manifest_files(on(inp, _BUNDLE, "orders")))


# five levels, an array and a path with dots; every third customer repeats a file with another hash
_DEEP = """SELECT o_orderkey AS k, '{"bundle_id":"b'||CAST(o_orderkey AS VARCHAR(20))||'","tasks":{"bs":{"path":"m","sha256":{"a.txt":"AA"},"components":{"t":{"members":[{"path":"m/x","sha256":{"c.txt":"cc"}},{"path":"m/x/..","sha256":{"a.txt":"'||CASE WHEN o_custkey%3=0 THEN 'ff' ELSE 'aa' END||'"},"parts":{"p":{"path":"../out","sha256":{"d.txt":"dd"}}}}]}}}}}' AS json FROM orders"""


@query(
    "a21_walk_manifests",
    """SELECT 'b'||CAST(o_orderkey AS VARCHAR) AS bundle_id, place, path, file, target, escapes, CASE WHEN h='?' THEN CASE WHEN o_custkey%3=0 THEN 'ff' ELSE 'aa' END ELSE h END AS sha256 FROM orders, (VALUES
 ('$.tasks.bs','m','a.txt','m/a.txt',false,'aa'), ('$.tasks.bs.components.t.members[0]','m/x','c.txt','m/x/c.txt',false,'cc'), ('$.tasks.bs.components.t.members[1]','m/x/..','a.txt','m/a.txt',false,'?'),
 ('$.tasks.bs.components.t.members[1].parts.p','../out','d.txt','../out/d.txt',true,'dd')) v(place,path,file,target,escapes,h)""",
)
def a21_walk_manifests(inp):
    return M.walk_manifests(on(inp, _DEEP, "orders"))


@query("a21_conflicting_targets", "SELECT 'b'||CAST(o_orderkey AS VARCHAR) AS bundle_id, 'm/a.txt' AS target, CAST(2 AS BIGINT) AS n, '$.tasks.bs|$.tasks.bs.components.t.members[1]' AS places FROM orders WHERE o_custkey%3=0")
def a21_conflicting_targets(inp):
    found = M.conflicting_targets(M.walk_manifests(on(inp, _DEEP, "orders")))
    return found.withColumn("places", F.array_join("places", "|"))


@query("m1_task_of", f"SELECT DISTINCT chip_id, lower(substr(chip_id,1,2)) AS task FROM {_ASSETS} a")
def m1_task_of(inp):
    return A.asset_table(on(inp, _FILES, "orders")).select("chip_id", X.task_of(F.col("chip_id")).alias("task")).distinct()


_YEAR = "SELECT o_orderkey AS id, CASE WHEN o_custkey%9=0 THEN 'n/a' ELSE CAST(1990+o_custkey%30 AS VARCHAR(20))||'-01-02' END AS text FROM orders"


@query("m2_year_of", f"SELECT id, coalesce(nullif(regexp_extract(text,'^([0-9][0-9][0-9][0-9])',1),''),'bad') AS year FROM ({_YEAR}) q")
def m2_year_of(inp):
    return on(inp, _YEAR, "orders").select("id", F.coalesce(X.year_of(F.col("text")), F.lit("bad")).alias("year"))


_EPSG = "SELECT o_orderkey AS id, CASE o_custkey%4 WHEN 0 THEN 'EPSG:32637' WHEN 1 THEN '32638.0' WHEN 2 THEN ' epsg:32637.0 ' ELSE '32637.5' END AS text FROM orders"


@query("m3_epsg_code", "SELECT o_orderkey AS id, CAST(CASE o_custkey%4 WHEN 1 THEN 32638 WHEN 3 THEN -1 ELSE 32637 END AS BIGINT) AS epsg FROM orders")
def m3_epsg_code(inp):
    return on(inp, _EPSG, "orders").select("id", F.coalesce(X.epsg_code(F.col("text")), F.lit(-1)).cast("bigint").alias("epsg"))


@query("m4_iso_utc", "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S')||'.'||lpad(CAST((epoch_us(ts)//1000)%1000 AS VARCHAR),3,'0')||'000Z' AS iso, (epoch_us(ts)//1000)//1000-7200 AS shifted FROM events WHERE (epoch_us(ts)//1000)%1000<>0 UNION ALL SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%S')||'Z', (epoch_us(ts)//1000)//1000-7200 FROM events WHERE (epoch_us(ts)//1000)%1000=0")
def m4_iso_utc(inp):
    e = inp.events.select("event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ms"), "ts")
    stamped = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return e.select("event_id", X.iso_from_millis(F.col("ms")).alias("iso"), F.unix_seconds(X.utc_timestamp(stamped)).alias("shifted"))


_IDS = "SELECT o_orderkey AS id, CASE o_custkey%4 WHEN 0 THEN 'ok-'||CAST(o_orderkey AS VARCHAR(20)) WHEN 1 THEN 'a/b' WHEN 2 THEN '' ELSE 'x y' END AS text FROM orders"


@query("m5_safe_id", f"SELECT id, regexp_full_match(text,'[A-Za-z0-9._-]+') AS safe, text<>'' AND text NOT LIKE '%/%' AS chip_safe FROM ({_IDS}) q")
def m5_safe_id(inp):
    return on(inp, _IDS, "orders").select("id", X.safe_id(F.col("text")).alias("safe"), X.safe_chip_id(F.col("text")).alias("chip_safe"))


@query("m6_canonical_sha256", """SELECT event_id, sha256('{"a":"'||event_type||'","b":"'||CAST(user_id AS VARCHAR)||'"}') AS digest FROM events""")
def m6_canonical_sha256(inp):
    fields = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return inp.events.select("event_id", X.canonical_sha256(fields).alias("digest"))


@query("m7_severity_name", "SELECT chip_id, pos, CASE cls WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'none' END AS severity FROM fx_class")
def m7_severity_name(inp):
    return inp.fx_class.select("chip_id", "pos", F.coalesce(X.severity_name(F.col("cls")), F.lit("none")).alias("severity"))


@query("m8_artifact_pairs", "SELECT o_orderkey AS k, n AS id, h AS href FROM orders, (VALUES ('summary','summary.json'),('mask_1','m/1.tif')) v(n,h) WHERE o_custkey%2=0 OR n='summary'")
def m8_artifact_pairs(inp):
    fields = F.create_map(
        F.lit("summary"), F.lit("summary.json"), F.when(F.col("o_custkey") % 2 == 0, "mask_1").otherwise("bad id"), F.lit("m/1.tif"), F.lit("up"), F.lit("../x"), F.lit("root"), F.lit("/etc")
    )
    return inp.orders.select(F.col("o_orderkey").alias("k"), F.inline(X.artifact_pairs(fields)))


@query("m9_without_private", "SELECT event_id, 'kind='||event_type AS kept FROM events")
def m9_without_private(inp):
    fields = F.create_map(F.lit("_secret"), F.col("props"), F.lit("kind"), F.col("event_type"))
    kept = F.transform(F.map_entries(X.without_private(fields)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return inp.events.select("event_id", F.array_join(kept, ",").alias("kept"))


_REG = """SELECT o_orderkey AS k, CASE o_custkey%3 WHEN 0 THEN '[{"bundle_id":"l'||CAST(o_orderkey AS VARCHAR(20))||'","status":"ready","tasks":["bs","af"]}]' WHEN 1 THEN '{"bundle_id":"m'||CAST(o_orderkey AS VARCHAR(20))||'","available":false,"status":"ready","tasks":{"af":{"x":1}}}'
 ELSE '{"bundles":[{"available":true,"tasks":["bs"]},{"bundle_id":"n'||CAST(o_orderkey AS VARCHAR(20))||'","tasks":[]}]}' END AS json FROM orders"""


@query(
    "m10_bundle_registry",
    """SELECT 'l'||CAST(o_orderkey AS VARCHAR) AS bundle_id, 'ready' AS status, 'af,bs' AS tasks FROM orders WHERE o_custkey%3=0 UNION ALL SELECT 'm'||CAST(o_orderkey AS VARCHAR), 'unavailable', 'af' FROM orders WHERE o_custkey%3=1
 UNION ALL SELECT 'official-v1', 'ready', 'bs' FROM orders WHERE o_custkey%3=2 UNION ALL SELECT 'n'||CAST(o_orderkey AS VARCHAR), 'unavailable', '' FROM orders WHERE o_custkey%3=2""",
)
def m10_bundle_registry(inp):
    return M.bundle_registry(on(inp, _REG, "orders")).withColumn("tasks", F.array_join("tasks", ","))


@query("m11_file_digests")
def m11_file_digests(inp):
    """Fingerprints of the table files themselves."""
    files = A.file_digests(inp.spark, inp.sf_dir, "*.parquet")
    return files.select("name", "size_bytes", "sha256", "mtime_utc")


_ARTIFACTS = """SELECT o_orderkey AS k, CASE o_custkey%3 WHEN 0 THEN '{"summary":"s.json","mask":["m/0.tif",7,"m/2.tif"],"extra":{"log":"l.txt","n":1,"up":"../x"}}'
 WHEN 1 THEN '["a.json"]' ELSE '{"bad id":"x","abs":"/etc","nested":[["y"]],"ok":"r.tif"}' END AS doc FROM orders"""


@query(
    "m8_artifact_entries",
    "SELECT o_orderkey AS k, id, href FROM orders JOIN (VALUES (0,'summary','s.json'),(0,'mask_0','m/0.tif'),(0,'mask_2','m/2.tif'),(0,'extra_log','l.txt'),(2,'ok','r.tif')) v(c,id,href) ON o_custkey%3=c",
)
def m8_artifact_entries(inp):
    docs = inp.spark.sql(_ARTIFACTS.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=inp.orders)
    return docs.select("k", F.inline(X.artifact_entries(F.col("doc"))))


_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":['||CAST(rw AS VARCHAR)||','||CAST(cl AS VARCHAR)||']},"properties":{"event_id":'||CAST(event_id AS VARCHAR)||',"scene_id":"'||scene_id||'"}}'"""


@query(
    "a14_feature_collection",
    f"""WITH f AS (SELECT event_id, {_FEATURE} AS v FROM fx_hotspot WHERE valid AND cls=1)
 SELECT CAST(0 AS BIGINT) AS pos, '{{"type":"FeatureCollection","features":[' AS value UNION ALL SELECT 2, ']}}' UNION ALL
 SELECT 1, CASE WHEN event_id=(SELECT min(event_id) FROM f) THEN v ELSE ','||v END FROM f""",
)
def a14_feature_collection(inp):
    fires = inp.fx_hotspot.where("valid and cls = 1")
    fires = fires.withColumn("point", F.struct(F.lit("Point").alias("type"), F.array("rw", "cl").alias("coordinates")))
    keyed = S.geojson_features(fires, "point", ["event_id", "scene_id"]).withColumn("event_id", F.get_json_object("value", "$.properties.event_id").cast("bigint"))
    return S.feature_collection(keyed, "event_id").select(F.col("pos").cast("bigint").alias("pos"), "value")
