"""Pairs and streams whose work must not be repeated per pair or per key."""

import datetime

import pytest
from pyspark.sql import functions as F

from ember.operators import joins as J
from ember.operators.indexing import salted_join
from ember.streaming import hotspots as H
from ember.streaming import requests as R

BASE = datetime.datetime(2024, 1, 1)


def test_bundles_meet_requests_without_counting_pairs(spark):
    requests = spark.createDataFrame([(1, ["af"]), (2, ["bs", "af", "af"]), (3, ["bs"]), (4, []), (5, None), (6, ["sar"])], "request_id int, tasks array<string>")
    bundles = spark.createDataFrame([(10, "ready", ["af", "bs"]), (11, "ready", ["bs"]), (12, "off", ["af"]), (13, "ready", ["x", "af"])], "bundle_id int, status string, tasks array<string>")
    pairs = J.capable_bundles(requests, bundles, rows_per_task=1)
    assert sorted(map(tuple, pairs.collect())) == [(1, 10), (1, 13), (2, 10), (3, 10), (3, 11)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = "".join(plan[: next(i for i, line in enumerate(plan) if "Join" in line)])
    assert "Aggregate" not in above  # nothing is grouped above the join that makes the pairs


def test_pairs_of_bundles_follow_list_by_list(spark):
    requests = spark.range(1000).select(F.col("id").alias("request_id"), F.array(F.lit("af")).alias("tasks"))
    requests = requests.unionByName(spark.createDataFrame([(None, ["af"])], "request_id bigint, tasks array<string>"))
    bundles = spark.range(4000).select((F.col("id") * 50).alias("bundle_id"), F.lit("ready").alias("status"), F.array(F.lit("af"), F.lit("bs")).alias("tasks"))
    pairs = J.capable_bundles(requests, bundles)
    assert pairs.count() == 1001 * 4000 == pairs.distinct().count()
    rows = [tuple(r) for r in pairs.limit(128 * 64).collect()]
    assert len({b for _, b in rows}) <= 2 * 128  # not all 4000: a file's next rows repeat the list of the last ones
    small = J.capable_bundles(requests.where("request_id < 7"), bundles.where("bundle_id < 500"), rows_per_task=2, per_list=3, per_group=2, per_book=2)
    assert sorted(map(tuple, small.collect())) == [(r, b) for r in range(7) for b in range(0, 500, 50)]


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_idempotency_keeps_one_state_per_shard(spark, tmp_path, cuts):
    rows = [(i, BASE + datetime.timedelta(seconds=i // 2), ["get", "put", None][i % 3], f"k{i % 40}", f"h{(i * i) % 7}") for i in range(300)]
    schema, folder = "event_id bigint, ts timestamp, kind string, idem_key string, payload_hash string", str(tmp_path / "log")
    for k in range(cuts):
        spark.createDataFrame(rows[k * 300 // cuts : (k + 1) * 300 // cuts], schema).coalesce(1).write.mode("append").parquet(folder)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.event_id: r.verdict for r in H.run_to_table(R.stream_idempotency(log, shards=4), "idempotency").collect()}
    first, want = {}, {}
    for i, _, kind, key, digest in rows:
        want[i] = "new" if (kind, key) not in first else "replay" if first[kind, key] == digest else "conflict"
        first.setdefault((kind, key), digest)
    assert got == want and len(set(want.values())) == 3

    run = R.stream_idempotency(log, shards=4).writeStream.format("memory").queryName(f"verdicts{cuts}").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 4


def test_pairs_are_not_gathered_in_a_few_tasks(spark):
    left = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("l"))
    right = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("r"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = salted_join(left, right, ["k"], F.col("l"), rows_per_task=5)
        assert pairs.count() == 4000
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert pairs.rdd.getNumPartitions() == tasks > 1  # a few kB, which adaptive execution would give one task
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
