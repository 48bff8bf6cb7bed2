"""Repeated lines dropped with levelled sorted runs of line keys.

A key is a line without ASCII white space at its ends and with A-Z lower-cased;
its 128-bit digest stands for it.  Documents come in batches by descending
``doc_id``, so the batch in which a key appears first has the document that
keeps the line.  The seen keys lie in *runs*: tables bucketed and sorted by
digest, each key in exactly one.  A batch is exchanged once, merged against
the runs without moving them, and the keys that no run has become a run of
their own; ``fan`` runs of one level are compacted into one of the next, so a
batch meets at most ``fan - 1`` runs per level.  Only keys that were met before
leave counts behind, which decide what is frequent; unique lines, the bulk, are
never looked at again.

Runs, counts and line tables lie in the shared folder.  Keys found in more than
1/4096 of all line rows, hence fewer than 4096, are matched by a broadcast of
that bound; any other key is too rare to fill a task.

Nulls, ties and repeats: every row is a document, so repeated rows count as
often as they occur and are treated alike; a null ``doc_id`` is smaller than
all others; rows that share the largest ``doc_id`` of a key all keep it.  A null
or empty text is one empty line.  Other columns of the input are not read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ember.llm.common import size_of, stored
from ember.llm.split import slices
from ember.session import checkpoint_root, scratch

_WHITE = " \t\n\x0b\x0c\r"
#: A key in more than this share of all line rows is frequent.
HOT_SHARE = 4096


def _row_key(doc_id, text: str | None) -> bytes:
    """Identity of a row; equal rows have one identity and one fate."""
    return xxhash.xxh3_128_digest(f"{doc_id}|".encode() + (text or "").encode("utf-8", "surrogatepass"))


def _line_rows(shortest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in slices(whole.column("text")):
                batch = whole.slice(start, stop - start)
                out = ([], [], [], [], [])
                for doc_id, batch_no, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "batch", "text"))):
                    places: dict[bytes, list[int]] = {}
                    for n, line in enumerate((text or "").split("\n")):
                        key = line.strip(_WHITE)
                        if len(key) >= shortest:
                            places.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(n)
                    if places:
                        row = _row_key(doc_id, text)
                        for values, value in zip(out, (list(places), [row] * len(places), [doc_id] * len(places), list(places.values()), [batch_no] * len(places))):
                            values.extend(value)
                types = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["key", "row", "doc_id", "lines", "batch"])

    return rows


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in slices(whole.column("text")):
            batch = whole.slice(start, stop - start)
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
                lines = (text or "").split("\n")
                gone = set(drops or ())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append("\n".join(line for n, line in enumerate(lines) if n not in gone) if gone else text or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"]
            )


def _with_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start, stop in slices(whole.column("text")):
            batch = whole.slice(start, stop - start)
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            rows = pa.array([_row_key(i, t) for i, t in zip(ids, texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), rows], ["doc_id", "text", "_row"])


class LineRuns:
    """Levelled runs of ``key, last``; a key lies in one run.

    Runs are external tables bucketed by key in the shared folder.  Their
    buckets are as many as the session's shuffle partitions, so a batch that is
    grouped by key meets them without a further exchange.
    """

    def __init__(self, spark: SparkSession, fan: int = 3):
        checkpoint_root(spark)
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._tables: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with a mark ``seen``, merged with one run after the other."""
        out = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            run = run.select(F.col("key").alias("_key"), F.lit(True).alias("_in")).hint("merge")
            out = out.join(run, F.col("key") == F.col("_key"), "left").withColumn("seen", F.col("seen") | F.coalesce("_in", F.lit(False))).drop("_key", "_in")
        return out

    def add(self, keys: DataFrame) -> None:
        """Add unseen ``key, last`` as a run and compact the levels that are full."""
        self._put(0, keys)
        level = 0
        while len(self.levels[level]) >= self.fan:
            full = [self.spark.table(t) for t in self.levels[level]]
            self.levels[level] = []
            self._put(level + 1, reduce(DataFrame.unionByName, full))
            level += 1

    def close(self) -> None:
        """Forget the tables; their files stay in the shared folder until that is cleared."""
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _put(self, level: int, keys: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        spread = keys.select("key", "last").repartition(self.buckets, "key")
        spread.write.format("parquet").option("path", scratch(self.spark, "run")).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self._tables.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)


def _batched(docs: DataFrame, batches: int) -> DataFrame:
    """``doc_id, text, batch``; batch 0 has the largest ids, nulls come last."""
    shares = [1 - (i + 1) / batches for i in range(batches - 1)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in shares]), 1000)).first()[0] if shares else None
    number = F.lit(0)
    for cut in sorted(set(cuts or ())):
        number = number + F.when(F.coalesce(F.col("doc_id") < cut, F.lit(True)), 1).otherwise(0)
    return docs.withColumn("batch", number.cast("int"))


def frequent_keys(lines: DataFrame, least: int, batches: int, fan: int = 3) -> DataFrame:
    """Keys of at least ``least`` rows: ``key, n_docs, last``; ``last`` is the largest ``doc_id``.

    ``lines`` has ``key, doc_id, batch`` with one row per key and document,
    larger ids in earlier batches.
    """
    runs = LineRuns(lines.sparkSession, fan)
    repeats = []
    for batch in range(batches):
        keys = lines.where(F.col("batch") == batch).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        marked = stored(runs.seen(keys), "batch")
        runs.add(marked.where("not seen"))
        # a key's first document is the one that its run stands for
        repeats.append(marked.select("key", F.when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1).alias("n")).where("n > 0"))
    counts = reduce(DataFrame.unionByName, repeats).groupBy("key").agg((F.sum("n") + 1).alias("n_docs")).where(F.col("n_docs") >= least)
    counts = stored(counts, "counts")
    parts = [counts.join(run.hint("merge"), "key").select("key", "n_docs", "last") for run in runs.runs()]
    found = stored(reduce(DataFrame.unionByName, parts), "frequent")
    runs.close()
    return found


def drop_repeated_lines(docs: DataFrame, shortest: int = 40, least: int = 5, batches: int = 6, fan: int = 3) -> DataFrame:
    """Texts without repeated lines: ``doc_id, n_lines, n_dropped, kept``.

    A key of at least ``shortest`` code points found in at least ``least``
    documents loses all its lines except in the largest ``doc_id`` holding it.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch(docs.sparkSession, "lines")
    schema = "key binary, row binary, doc_id bigint, lines array<int>, batch int"
    _batched(docs, batches).mapInArrow(_line_rows(shortest), schema).write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(schema).parquet(path)
    frequent = frequent_keys(lines, least, batches, fan)

    hot = F.col("n_docs") > max(least, size_of(lines) // HOT_SHARE)
    own = lines.select("key", "row", "doc_id", "lines")
    # fewer than HOT_SHARE keys can be in more than 1/HOT_SHARE of the rows
    parts = [own.join(F.broadcast(frequent.where(hot).drop("n_docs")), "key"), own.join(frequent.where(~hot).drop("n_docs"), "key")]
    drops = parts[0].unionByName(parts[1]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("row", "key").agg(F.max("lines").alias("lines")).groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("drops"))
    drops = stored(drops, "drops")

    keyed = docs.mapInArrow(_with_row, "doc_id bigint, text string, _row binary")
    joined = keyed.join(drops, F.col("_row") == F.col("row"), "left").select("doc_id", "text", "drops")
    return joined.mapInArrow(_kept_rows, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
