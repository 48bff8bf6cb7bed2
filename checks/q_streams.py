"""N: request logs and hotspot streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import VIEWS
from ember.streaming import hotspots as H
from ember.streaming import requests as R

LIMIT = 3


def log(inp):
    return inp.fx_log.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(inp):
    """The events table as a file stream."""
    schema = inp.events.schema
    return inp.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(inp.sf_dir)


# trailing hour and three admissions: each admission is found from the last one
_ADMIT = f"""WITH RECURSIVE l AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 walk(client, k, event_id, times, admitted) AS (SELECT client, k, event_id, [us], true FROM l WHERE k=1
 UNION ALL SELECT l.client, l.k, l.event_id, CASE WHEN len(list_filter(w.times, lambda t: t>l.us-3600000000))<{LIMIT} THEN list_append(list_filter(w.times, lambda t: t>l.us-3600000000), l.us) ELSE list_filter(w.times, lambda t: t>l.us-3600000000) END,
  len(list_filter(w.times, lambda t: t>l.us-3600000000))<{LIMIT} FROM walk w JOIN l ON l.client=w.client AND l.k=w.k+1)
 SELECT client, event_id, admitted FROM walk"""


@query("n1_admission", _ADMIT)
def n1_admission(inp):
    return R.admission(log(inp), LIMIT, 3600).select("client", "event_id", "admitted")


@query("n1_stream_admission", _ADMIT)
def n1_stream_admission(inp):
    source = event_stream(inp).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"))
    flags = H.run_to_end(lambda events: R.stream_admission(events, LIMIT, 3600), source, "ts", "admission")
    return flags.select("client", "event_id", "admitted")


_IDEM = """SELECT event_id, kind, idem_key, CASE WHEN k=1 THEN 'new' WHEN payload_hash=f THEN 'replay' ELSE 'conflict' END AS verdict FROM (SELECT *, row_number() OVER w AS k, first_value(payload_hash) OVER w AS f FROM fx_log WINDOW w AS (PARTITION BY kind, idem_key ORDER BY ts, event_id)) q"""


@query("n2_idempotency", _IDEM)
def n2_idempotency(inp):
    return R.idempotency(inp.fx_log).select("event_id", "kind", "idem_key", "verdict")


@query("n2_stream_idempotency", _IDEM)
def n2_stream_idempotency(inp):
    source = event_stream(inp).select(
        "event_id", "ts", F.col("event_type").alias("kind"), F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string")).alias("idem_key"), F.md5(F.col("props").cast("binary")).alias("payload_hash")
    )
    return H.run_to_table(R.stream_idempotency(source), "idempotency").select("event_id", "kind", "idem_key", "verdict")


_OWNER = "coalesce(source_scene_id||':'||strftime(observed_at,'%Y-%m-%d %H:%M:%S'), scene_id)"


@query(
    "n3_stream_hotspots",
    f"""SELECT CAST(day AS VARCHAR) AS period, cell_owner, rw AS cell_row, cl AS cell_col, scene_id, event_id, round(CAST(score AS DOUBLE),6)+0.0 AS score FROM (SELECT *, date_trunc('day', ts) AS day, {_OWNER} AS cell_owner,
 row_number() OVER (PARTITION BY source_scene_id IS NOT NULL, {_OWNER}, rw, cl, date_trunc('day', ts) ORDER BY least(rw+1,cl+1,40-rw,40-cl) DESC, scene_id, event_id) AS k FROM fx_hotspot WHERE valid AND (source_scene_id IS NOT NULL OR cls=1)) q WHERE k=1 AND cls=1""",
)
def n3_stream_hotspots(inp):
    """Winners per cell and day, an hour behind the newest report."""
    sql = VIEWS["fx_hotspot"].replace("FROM events", "FROM {events}")

    def build(events):
        return H.stream_hotspots(inp.spark.sql(sql, events=events), F.lit(40), F.lit(40), carry=("score", "event_id"), ties=("event_id",))

    won = H.run_to_end(build, event_stream(inp), "ts", "hotspots")
    return won.select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "cell_owner", "cell_row", "cell_col", "scene_id", "event_id", (F.round(F.col("score").cast("double"), 6) + 0.0).alias("score"))
