"""Streaming admission: flags per request, whatever the triggers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.streaming import hotspots as H
from ember.streaming import requests as R

BASE = datetime.datetime(2024, 1, 1)


def log_rows():
    rng = np.random.default_rng(5)
    rows = [(int(c), int(i), BASE + datetime.timedelta(seconds=float(s))) for c in range(4) for i, s in enumerate(np.round(rng.uniform(0, 3000, 90), 3), start=100 * c)]
    rows += [(9, 900 + i, BASE + datetime.timedelta(seconds=60 * (i // 2))) for i in range(8)]  # ties and exact window ends
    return sorted(rows, key=lambda r: r[2])


def plain(rows, limit, span):
    out, kept = {}, {}
    for c, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = kept[c] = [k for k in kept.get(c, []) if k > t - datetime.timedelta(seconds=span)]
        out[i] = len(mine) < limit
        if out[i]:
            mine.append(t)
    return out


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_admission_does_not_depend_on_triggers(spark, tmp_path, cuts):
    rows = log_rows()
    schema = "client bigint, event_id bigint, ts timestamp"
    folder = str(tmp_path / "log")
    rng = np.random.default_rng(2)
    for k in range(cuts):  # shuffled inside a file
        part = rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts]
        part = [part[j] for j in rng.permutation(len(part))]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = H.run_to_end(lambda e: R.stream_admission(e, 3, 60, "2 minutes"), events, "ts", "admission").collect()
    assert len(got) == len(rows) and {r.event_id: r.admitted for r in got} == plain(rows, 3, 60)
    assert {r.event_id: r.ts for r in got} == {i: t for _, i, t in rows}
    assert not all(r.admitted for r in got)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = log_rows()
    log = spark.createDataFrame(rows, "client bigint, event_id bigint, ts timestamp")
    log.write.parquet(str(tmp_path / "log"))
    events = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    streamed = H.run_to_end(lambda e: R.stream_admission(e, 2, 90), events, "ts", "admission").select("client", "event_id", "admitted")
    batch = R.admission(log, 2, 90).select("client", "event_id", "admitted")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert batch.where(~F.col("admitted")).count() > 0


SPOTS = "event_id bigint, source_scene_id string, grid_row_offset bigint, grid_col_offset bigint, scene_id string, observed_at timestamp, ts timestamp, rw bigint, cl bigint, cls int, valid boolean, score double"


def spot_rows():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        shared, day = i % 3 == 0, i // 100
        ts = BASE + datetime.timedelta(days=day, seconds=float(rng.integers(0, 86_000)))
        seen = BASE + datetime.timedelta(days=day)
        rows.append((i, f"src{i % 2}" if shared else None, 0 if shared else None, 0 if shared else None, f"sc{rng.integers(4)}", seen, ts, int(rng.integers(6)), int(rng.integers(6)), int(rng.integers(2)), bool(rng.random() < 0.9), float(i)))
    return sorted(rows, key=lambda r: r[6])


def best_spots(rows):
    best = {}
    for i, src, _, _, scene, seen, ts, rw, cl, cls, valid, score in rows:
        if valid and (src is not None or cls == 1):
            owner = f"{src}:{seen}" if src else scene
            rank = (-min(rw + 1, cl + 1, 6 - rw, 6 - cl), scene, i)
            key = (ts.replace(hour=0, minute=0, second=0), src is not None, owner, rw, cl)
            best[key] = min(best.get(key, (rank, (cls, i))), (rank, (cls, i)))
    return {(k[0], k[2], k[3], k[4], i) for k, (_, (cls, i)) in best.items() if cls == 1}


def test_stream_hotspots_keep_the_best_and_forget(spark, tmp_path):
    rows, folder = spot_rows(), str(tmp_path / "spots")
    for day in range(5):
        spark.createDataFrame([r for r in rows if (r[6] - BASE).days == day], SPOTS).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(spark.createDataFrame([], SPOTS).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    build = lambda e: H.stream_hotspots(e, F.lit(6), F.lit(6), carry=("score", "event_id"), ties=("event_id",))
    got = H.run_to_end(build, events, "ts", "spots").collect()
    found = {(r.period, r.cell_owner, r.cell_row, r.cell_col, r.event_id) for r in got}
    assert len(got) == len(found) and found == best_spots(rows)

    run = build(events).writeStream.format("memory").queryName("spots").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held[-1] < 0.5 * sum(len([r for r in rows if (r[6] - BASE).days == d]) for d in range(5))  # closed days are gone
    assert max(held) <= 2 * 100


def test_stream_hotspots_drop_what_comes_too_late(spark, tmp_path):
    rows = [r for r in spot_rows() if (r[6] - BASE).days in (0, 2)]
    folder = str(tmp_path / "late")
    early, late = [r for r in rows if r[0] % 7], [r for r in rows if r[0] % 7 == 0 and (r[6] - BASE).days == 0]
    spark.createDataFrame(early, SPOTS).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(spark.createDataFrame([], SPOTS).schema).parquet(folder)
    build = lambda e: H.stream_hotspots(e, F.lit(6), F.lit(6), carry=("score", "event_id"), ties=("event_id",))
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    H._drain(build(events), out, progress, "append")
    spark.createDataFrame(late, SPOTS).coalesce(1).write.mode("append").parquet(folder)
    H._drain(build(events), out, progress, "append")
    got = {(r.period, r.cell_owner, r.cell_row, r.cell_col, r.event_id) for r in spark.read.parquet(out).collect()}
    assert late and got == {w for w in best_spots(early) if w[0] == BASE}
