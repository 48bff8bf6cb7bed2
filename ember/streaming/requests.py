"""Admission and idempotency rules over request logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_SECONDS = 60
OUT = "client string, event_id bigint, ts timestamp, admitted boolean"


def _admit(times: deque, now: int, limit: int, span: int) -> bool:
    """Apply the trailing-window rule to one request (microseconds)."""
    while times and times[0] <= now - span:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def bursts(log: DataFrame, seconds: int = WINDOW_SECONDS, slice_seconds: int = 3600) -> DataFrame:
    """Number each client's bursts: stretches without a gap of ``seconds``.

    A gap that long empties the trailing window, so bursts are independent and
    a busy client spreads over many groups.  Gaps are found inside time slices
    and across slice borders from one row per slice, never over a client's
    whole log at once.
    """
    micros = F.unix_micros(F.col("ts"))
    sliced = log.withColumns({"_us": micros, "_slice": F.floor(micros / (slice_seconds * 1_000_000))})
    inside = Window.partitionBy("client", "_slice").orderBy("_us", "event_id")
    marked = sliced.withColumn("_prev", F.lag("_us").over(inside))
    ends = sliced.groupBy("client", "_slice").agg(F.max("_us").alias("_last"), F.min("_us").alias("_first"))
    across = Window.partitionBy("client").orderBy("_slice")
    edges = ends.select("client", "_slice", F.lag("_last").over(across).alias("_before"))
    gap = seconds * 1_000_000
    flagged = marked.join(edges, ["client", "_slice"]).withColumn("_from", F.coalesce("_prev", "_before")).withColumn(
        "_new", F.when(F.col("_from").isNull() | (F.col("_us") - F.col("_from") >= gap), 1).otherwise(0)
    )
    counts = flagged.groupBy("client", "_slice").agg(F.sum("_new").alias("_k"))
    starts = counts.select("client", "_slice", F.coalesce(F.sum("_k").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    number = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_n", number).join(starts, ["client", "_slice"]).withColumn("burst", F.col("_base") + F.col("_n")).select(*log.columns, "burst")


def admission(log: DataFrame, limit: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Which requests a trailing-window limit admits; only admitted ones count.

    ``log``: client, event_id, ts (timestamp).  The rule is sequential inside a
    burst, so bursts are laid out in order inside partitions and streamed
    through with at most ``limit`` times held - no group is ever collected.
    """
    span = seconds * 1_000_000
    ready = bursts(log.select(F.col("client").cast("string").alias("client"), "event_id", "ts"), seconds)
    ordered = ready.repartition("client", "burst").sortWithinPartitions("client", "burst", "ts", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, deque()
        for pdf in batches:
            flags = []
            for key, now in zip(zip(pdf["client"], pdf["burst"]), pdf["ts"].astype("int64") // 1000 if str(pdf["ts"].dtype).startswith("datetime64[ns") else pdf["ts"].astype("int64")):
                if key != current:
                    current, times = key, deque()
                flags.append(_admit(times, int(now), limit, span))
            yield pdf.assign(admitted=flags)[["client", "event_id", "ts", "admitted"]]

    return ordered.mapInPandas(walk, OUT)


def stream_admission(log: DataFrame, limit: int, seconds: int = WINDOW_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """The same rule on a stream, with a flag per request.

    A request is judged when the watermark has passed it: until then it waits
    in its client's state, so the flags do not depend on how the log is cut
    into triggers.  Event-time timers wake clients that send nothing more.
    State holds at most ``limit`` admitted times and the requests of the last
    ``lateness``; it is removed once both are gone.  Requests older than the
    watermark are dropped by Spark before they arrive here.
    """
    span = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, us, ids = state.get if state.exists else ((), (), ())
        times, waiting = deque(kept), list(zip(us, ids))
        for rows in batches:  # none when a timer wakes the client
            waiting += zip(rows["us"].tolist(), rows["event_id"].tolist())
        waiting.sort()
        mark = state.getCurrentWatermarkMs() * 1000
        ready = [w for w in waiting if w[0] <= mark]
        waiting = waiting[len(ready) :]
        flags = [_admit(times, at, limit, span) for at, _ in ready]
        while times and times[0] <= mark - span:
            times.popleft()
        if waiting or times:
            state.update((list(times), [w[0] for w in waiting], [w[1] for w in waiting]))
            wake = waiting[0][0] if waiting else times[-1] + span
            state.setTimeoutTimestamp(max(-(-wake // 1000), mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": key[0], "event_id": [i for _, i in ready], "ts": pd.to_datetime([at for at, _ in ready], unit="us", utc=True), "admitted": flags})

    keyed = log.withWatermark("ts", lateness).select(F.col("client").cast("string").alias("client"), "event_id", "ts", F.unix_micros("ts").alias("us"))
    held = "times array<bigint>, us array<bigint>, ids array<bigint>"
    return keyed.groupBy("client").applyInPandasWithState(step, OUT, held, "append", GroupStateTimeout.EventTimeTimeout)


def idempotency(log: DataFrame) -> DataFrame:
    """Tag requests new, replay or conflict against the first of their key.

    The first payload per (kind, key) is an aggregate (map-side minimum), and
    joins back; a hot key is split by the adaptive join instead of filling one
    window.
    """
    order = F.struct("ts", "event_id")
    first = log.groupBy("kind", "idem_key").agg(F.min_by(F.struct("payload_hash", "event_id"), order).alias("_f"))
    tag = F.when(F.col("event_id") == F.col("_f.event_id"), "new").when(F.col("payload_hash") == F.col("_f.payload_hash"), "replay").otherwise("conflict")
    return log.join(first, ["kind", "idem_key"]).withColumn("verdict", tag).drop("_f")


def stream_idempotency(log: DataFrame, shards: int = 8192) -> DataFrame:
    """Streaming form: state holds the first payload hash of a key.

    Keys are dealt by hash to a fixed number of ``shards``, so Python is called
    once per shard and trigger and not once per key; a shard's state lists its
    keys.  ``shards`` must stay the same over the life of a stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, keys, hashes = state.get if state.exists else ((), (), ())
        known = dict(zip(zip(kinds, keys), hashes))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for kind, idem_key, digest in zip(rows["kind"], rows["idem_key"], rows["payload_hash"]):
            first = known.get((kind, idem_key))
            if first is None:
                known[kind, idem_key] = digest
                out.append("new")
            else:
                out.append("replay" if digest == first else "conflict")
        state.update(([k for k, _ in known], [i for _, i in known], list(known.values())))
        yield pd.DataFrame({"kind": rows["kind"], "idem_key": rows["idem_key"], "event_id": rows["event_id"], "verdict": out})

    dealt = log.withColumn("shard", F.pmod(F.xxhash64("kind", "idem_key"), F.lit(shards)))
    held = "kinds array<string>, keys array<string>, hashes array<string>"
    return dealt.groupBy("shard").applyInPandasWithState(
        step, "kind string, idem_key string, event_id bigint, verdict string", held, "append", GroupStateTimeout.NoTimeout
    )
