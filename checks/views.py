"""Raster-shaped views derived from the given tables.

The tables hold no rasters, so orders become pixels (dense chips of 15 x 20,
300 consecutive order keys each), embeddings become single-band 8 x 8 chips,
events become fire candidates and requests, customers become areas of interest.
Every view reads its whole table.  The text is portable: Spark and DuckDB both
run it unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)
HEIGHT, WIDTH = 15, 20


def _mod(a: int, b: int, m: int) -> str:
    return f"(o_custkey*{a}+pos*{b})%{m}"


_GRID = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority<>'5-LOW' AS valid,
 CAST(floor(o_orderkey/300) AS BIGINT) AS chip_id, o_orderkey%300 AS pos,
 CAST(floor((o_orderkey%300)/20) AS BIGINT) AS rw, (o_orderkey%300)%20 AS cl FROM orders"""

_SCORES = ", ".join(
    [f"CAST(CAST(a{i} AS DOUBLE)/100 AS FLOAT) AS t{i}" for i in range(4)]
    + [f"CAST(CAST(b{i} AS DOUBLE)/100 AS FLOAT) AS n{i}" for i in range(4)]
)
_RAW = ", ".join(
    [f"{_mod(3 + 2 * i, 7 - i, 29)}+1+CASE WHEN truth={i} THEN {40 if i == 0 else 30} ELSE 0 END AS a{i}" for i in range(4)]
    + [f"{_mod(13 + 4 * i, 1 + i, 37)}+1+CASE WHEN truth={i} THEN {30 if i == 0 else 20} ELSE 0 END AS b{i}" for i in range(4)]
)

_AF = {
    "I1": _mod(3, 7, 1000), "I2": _mod(5, 11, 1000), "I3": _mod(7, 13, 1000),
    "I4": f"280+{_mod(11, 3, 90)}", "I5": f"270+{_mod(13, 5, 60)}",
    "solar_zenith": _mod(17, 1, 90), "sensor_zenith": _mod(19, 2, 70),
    "landcover": _mod(23, 1, 100), "dem": _mod(29, 10, 3000), "t2m": f"265+{_mod(31, 1, 45)}", "rh2m": _mod(37, 1, 101), "wind_speed": _mod(41, 1, 25),
}
_OPT = ("B2", "B3", "B4", "B5", "B6", "B7", "B8A", "B11", "B12")
_BS = {f"{w}_{b}": f"{_mod(3 + 2 * i + (20 if w == 'post' else 0), 5 + i, 9000)}+1" for w in ("pre", "post") for i, b in enumerate(_OPT)}
_BS |= {"pre_SCL": _mod(2, 1, 12), "post_SCL": _mod(3, 1, 12)}
_BS |= {"pre_VV": f"-({_mod(5, 3, 2500)})", "pre_VH": f"-({_mod(7, 3, 3000)})", "post_VV": f"-({_mod(11, 3, 2500)})", "post_VH": f"-({_mod(13, 3, 3000)})"}
_BS |= {"dem": _mod(17, 10, 3000), "slope": _mod(19, 1, 90), "landcover": _mod(23, 1, 100)}


def _nan(name: str, expr: str) -> str:
    if name in ("I4", "I1"):
        k = 97 if name == "I4" else 89
        return f"CASE WHEN o_custkey%{k}=0 THEN CAST('NaN' AS FLOAT) ELSE CAST({expr} AS FLOAT) END AS {name}"
    return f"CAST({expr} AS FLOAT) AS {name}"


VIEWS: dict[str, str] = {
    "fx_grid": _GRID,
    # scored pixels of both scorers with reference classes and validity
    "fx_pixel": f"""SELECT chip_id, rw, cl, pos, CASE WHEN chip_id%2=0 THEN 'af' ELSE 'bs' END AS task, truth, valid, {_SCORES}
 FROM (SELECT *, {_RAW} FROM (SELECT *, CASE WHEN o_custkey%11=0 THEN o_custkey%4
   ELSE (CAST(floor(rw/4) AS BIGINT)+CAST(floor(cl/5) AS BIGINT)+chip_id)%4 END AS truth FROM fx_grid) q1) q2""",
    # class pixels: blocky with noise
    "fx_class": """SELECT chip_id, rw, cl, pos, task, valid, truth AS cls FROM fx_pixel""",
    "fx_af": "SELECT chip_id, rw, cl, pos, CASE WHEN valid THEN CAST(1 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS valid, "
    + ", ".join(_nan(n, e) for n, e in _AF.items())
    + " FROM fx_grid",
    "fx_bs": "SELECT chip_id, rw, cl, pos, " + ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in _BS.items()) + " FROM fx_grid",
    # chip metadata: 20 m pixels, aligned grids, neighbours overlap, some grids shared
    "fx_meta": """SELECT chip_id, kind, epsg, x_min, y_min, x_min+400 AS x_max, y_min+300 AS y_max, date_pre, date_post, acquired_at, cloud_frac, split,
 n_fire_px, sev1_px, sev2_px, sev3_px FROM (
 SELECT chip_id, CASE WHEN chip_id%2=0 THEN 'af' ELSE 'bs' END AS kind, 32637+place%2 AS epsg, 300000+(place%7)*240 AS x_min,
  5000000+CAST(floor(place/7) AS BIGINT)*240 AS y_min, date_pre, date_pre+INTERVAL 40 DAY AS date_post, date_pre+INTERVAL 1 HOUR AS acquired_at,
  CAST(cloud AS DOUBLE)/100 AS cloud_frac, CASE WHEN chip_id%5=0 THEN 'val' ELSE 'train' END AS split, n1 AS n_fire_px, n1 AS sev1_px, n2 AS sev2_px, n3 AS sev3_px
 FROM (SELECT chip_id, chip_id-CASE WHEN chip_id%10=6 THEN 1 ELSE 0 END AS place, max(CASE WHEN pos=0 THEN o_orderdate END) AS date_pre, sum(o_custkey)%50 AS cloud,
   sum(CASE WHEN o_custkey%4=1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN o_custkey%4=2 THEN 1 ELSE 0 END) AS n2, sum(CASE WHEN o_custkey%4=3 THEN 1 ELSE 0 END) AS n3
   FROM fx_grid GROUP BY chip_id) m) k""",
    # the same chips on a 0.01 degree lattice: whole-number cells, exact rectangles
    "fx_geo": """SELECT chip_id, 's'||CAST(chip_id AS VARCHAR(20)) AS scene_id, kind AS task, acquired_at, date_pre, date_post, 4326 AS epsg,
 (place%7)*12 AS gx0, (CAST(floor(place/7) AS BIGINT)%400)*9 AS gy0 FROM (SELECT *, chip_id-CASE WHEN chip_id%10=6 THEN 1 ELSE 0 END AS place FROM fx_meta) m""",
    "fx_aoi": """SELECT s_suppkey AS request_id, CAST((s_suppkey*7)%70 AS DOUBLE)/100+30.003 AS aw, 49.9-CAST((s_suppkey*9)%630 AS DOUBLE)/100-0.004 AS as_,
 CAST((s_suppkey*7)%70 AS DOUBLE)/100+30.153 AS ae, 50.02-CAST((s_suppkey*9)%630 AS DOUBLE)/100-0.004 AS an, 1992+s_suppkey%3 AS start_year FROM supplier""",
    "fx_band": None,  # array unnesting differs; see load() and oracle_view()
    "fx_hotspot": """SELECT event_id, CASE WHEN event_id%4=0 THEN 's'||CAST(user_id%10 AS VARCHAR(20)) END AS source_scene_id,
 CASE WHEN event_id%4=0 THEN CAST(0 AS BIGINT) END AS grid_row_offset, CASE WHEN event_id%4=0 THEN CAST(0 AS BIGINT) END AS grid_col_offset,
 'sc'||CAST(event_id%7 AS VARCHAR(20)) AS scene_id, date_trunc('day', ts) AS observed_at, ts, CAST(floor(event_id/4) AS BIGINT)%40 AS rw,
 CAST(floor(event_id/28) AS BIGINT)%40 AS cl, CASE WHEN event_type IN ('error','click') THEN 1 ELSE 0 END AS cls, event_type<>'view' AS valid, value/500 AS score FROM events""",
    "fx_scene": """SELECT 's'||CAST(o_orderkey AS VARCHAR(20)) AS scene_id, CASE WHEN o_orderstatus='F' THEN 'af' ELSE 'bs' END AS task, o_orderdate AS t_post,
 o_orderkey%90 AS gap_days, CAST((o_orderkey*31337)%35700 AS DOUBLE)/100-179.5 AS w, CAST((o_orderkey*27644)%16600 AS DOUBLE)/100-84.5 AS s,
 CAST((o_orderkey*31337)%35700 AS DOUBLE)/100-177.5 AS e, CAST((o_orderkey*27644)%16600 AS DOUBLE)/100-82.5 AS n, CAST(o_custkey%101 AS DOUBLE) AS cloud_percent FROM orders""",
    "fx_request": """SELECT c_custkey AS request_id, CASE WHEN c_nationkey%2=0 THEN 'af' ELSE 'bs' END AS task,
 CAST((c_custkey*7919)%35300 AS DOUBLE)/100-178 AS aw, CAST((c_custkey*10473)%16300 AS DOUBLE)/100-84 AS as_, CAST((c_custkey*7919)%35300 AS DOUBLE)/100-172 AS ae,
 CAST((c_custkey*10473)%16300 AS DOUBLE)/100-78 AS an, 1995+c_custkey%6 AS start_year FROM customer""",
    "fx_log": """SELECT event_id, ts, CAST(user_id AS VARCHAR(20)) AS client, event_type AS kind,
 CAST(user_id AS VARCHAR(20))||':'||CAST(event_id%50 AS VARCHAR(20)) AS idem_key, md5(props) AS payload_hash FROM events""",
    # a closed hexagon per customer; every 13th is left open, every 17th is a bow-tie
    "fx_vertex": "SELECT aoi_id, part, ring, seq, cx+dx AS lon, cy+dy AS lat FROM (SELECT *, CAST((aoi_id*7919)%35000 AS DOUBLE)/100-175 AS cx, CAST((aoi_id*10473)%16000 AS DOUBLE)/100-80 AS cy FROM ("
    + " UNION ALL ".join(
        f"SELECT c_custkey AS aoi_id, 0 AS part, 0 AS ring, {i} AS seq, "
        f"CAST({dx} AS DOUBLE) AS dx, CAST(CASE WHEN c_custkey%17=0 THEN {bdy} ELSE {dy} END AS DOUBLE)/2 AS dy FROM customer"
        + (" WHERE c_custkey%13<>0" if i == 6 else "")
        for i, (dx, dy, bdy) in enumerate([(-2, 0, 0), (-1, -3, 3), (1, -3, -3), (2, 0, 0), (1, 3, 3), (-1, 3, -3), (-2, 0, 0)])
    )
    + ") v) u",
}

_BAND_SPARK = """SELECT CAST(vec_id AS BIGINT) AS chip_id, CAST(pos AS BIGINT) AS pos, CAST(floor(pos/8) AS BIGINT) AS rw, CAST(pos%8 AS BIGINT) AS cl, v, label
 FROM {embeddings} LATERAL VIEW posexplode(embedding) AS pos, v"""
_BAND_DUCK = """SELECT vec_id AS chip_id, pos, CAST(floor(pos/8) AS BIGINT) AS rw, pos%8 AS cl, v, label
 FROM (SELECT vec_id, label, unnest(embedding) AS v, CAST(generate_subscripts(embedding,1)-1 AS BIGINT) AS pos FROM embeddings) b"""


def _inputs(sql: str) -> list[str]:
    names = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql))
    return sorted(n for n in names if n in VIEWS or n in TABLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame (nothing is registered in the catalog)."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    if name == "fx_band":
        return spark.sql(_BAND_SPARK, embeddings=table(spark, sf_dir, "embeddings"))
    needs = _inputs(sql)
    for n in needs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in needs})


def oracle_view(name: str) -> str:
    return _BAND_DUCK if name == "fx_band" else VIEWS[name]


def with_views(body: str) -> str:
    """Prefix a SQL body with the views it (transitively) reads."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", sql) and n not in order:
                visit(oracle_view(n))
                order.append(n)

    visit(body)
    views = [f"{n} AS ({oracle_view(n)})" for n in order]
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*views, text[15:]])
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join([*views, text[5:]])
    return ("WITH " + ", ".join(views) + " " if views else "") + text
