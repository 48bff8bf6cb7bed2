"""Asset listings: discovery, completeness, checksums and provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ember.functions.text import CHIP_ID, clean_url, task_of

# File suffix of every input asset -> asset key.
SUFFIXES = {
    "VIIRS_I1-I5": "viirs",
    "AUX": "aux",
    "Sentinel-2_pre": "s2_pre",
    "Sentinel-2_post": "s2_post",
    "Sentinel-1_pre": "s1_pre",
    "Sentinel-1_post": "s1_post",
}
REQUIRED = {"af": ("aux", "mask", "viirs"), "bs": ("aux", "mask", "s1_post", "s1_pre", "s2_post", "s2_pre")}


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, length, modificationTime`` below a folder; contents stay unread."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    )


#: Larger files are read in splits; one row holds at most 2 GB.
WHOLE = 1 << 28
#: Endings that the reader of splits would unpack; such files are read whole.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
_BLOCK = 1 << 14
_BOM = b"\xef\xbb\xbf"


def _blocks(batches):
    """Lines in reading order to blocks of at least ``_BLOCK`` bytes per split."""
    at, held, size, seq = None, [], 0, 0

    def block():
        return pa.RecordBatch.from_pylist([{"path": at[0], "size": at[1], "start": at[2], "seq": seq, "bytes": b"\n".join([*held, b""])}], _BLOCKS)

    for batch in batches:
        for *key, line in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at or size >= _BLOCK:
                if held:
                    yield block()
                seq, held, size, at = seq + 1 if key == at else 0, [], 0, key
            held.append(line)
            size += len(line) + 1
    if held:
        yield block()


def _sha256(batches):
    """Blocks sorted by path, start and seq to one digest per path; a batch is held at a time."""
    path = size = done = last = None
    plain = marked = hashlib.sha256()

    def digest():
        # the reader drops a leading byte order mark, and adds a line end where the last line has none
        for hashed, full in ((plain, size), (marked, size - len(_BOM))):
            if done + len(last) - full in (0, 1):
                hashed.update(last[: full - done])
                return pa.RecordBatch.from_pylist([{"path": path, "sha256": hashed.hexdigest()}])
        raise ValueError(f"{path}: read {done + len(last)} of {size} bytes")

    for batch in batches:
        for name, length, data in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "bytes"))):
            if name != path:
                if path is not None:
                    yield digest()
                path, size, done, last, plain, marked = name, length, 0, b"", hashlib.sha256(), hashlib.sha256(_BOM)
            plain.update(last)
            marked.update(last)
            done, last = done + len(last), data
    if path is not None:
        yield digest()


_BLOCKS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("bytes", pa.binary())])


def file_digests(spark: SparkSession, root: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """``path, name, size_bytes, sha256, mtime_utc``.

    Files up to ``whole`` bytes are hashed where the bytes are.  Larger ones are
    read in splits, as lines, and their blocks hashed in order: SHA-256 takes a
    file's bytes one after the other, so one task hashes a file, a batch of blocks
    at a time.
    """
    below = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    files = spark.read.format("binaryFile").options(**below).load(root)
    at_once = (F.col("_metadata.file_size") <= whole) | F.lower("_metadata.file_path").rlike(PACKED)  # known from the listing, so other files stay unread
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.options(**below, lineSep="\n").text(root).where(~at_once)
    blocks = lines.select(*meta, F.col("value").cast("binary").alias("bytes")).mapInArrow(_blocks, "path string, size bigint, start bigint, seq bigint, bytes binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = blocks.repartition(tasks, "path").sortWithinPartitions("path", "start", "seq").mapInArrow(_sha256, "path string, sha256 string")
    listed = ["path", "length", "modificationTime"]
    small = files.where(at_once).select(*listed, F.sha2("content", 256).alias("sha256"))
    large = files.where(~at_once).select(*listed, F.col("_metadata.file_path").alias("_uri")).join(hashed.withColumnRenamed("path", "_uri"), "_uri").drop("_uri")
    return small.unionByName(large).select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.col("length").alias("size_bytes"),
        "sha256",
        F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime_utc"),
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def asset_table(files: DataFrame, path: str = "path") -> DataFrame:
    """``chip_id, key, path`` of input rasters; other files are left out."""
    name = base_name(F.col(path))
    key = chip = None
    for suffix, tag in SUFFIXES.items():
        ending = f"_{suffix}.tif"
        hit = name.endswith(ending)
        stem = F.substring(name, 1, F.length(name) - len(ending))
        key = F.when(hit, tag) if key is None else key.when(hit, tag)
        chip = F.when(hit, stem) if chip is None else chip.when(hit, stem)
    return files.select(chip.alias("chip_id"), key.alias("key"), F.col(path).alias("path")).where(F.col("chip_id").rlike(CHIP_ID))


def duplicate_assets(assets: DataFrame) -> DataFrame:
    return assets.groupBy("chip_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def asset_map(assets: DataFrame) -> DataFrame:
    """One map key -> path per chip (at most one entry per asset key)."""
    pairs = F.array_sort(F.collect_set(F.struct("key", "path")))
    unique = assets.groupBy("chip_id", "key").agg(F.min("path").alias("path"))
    return unique.groupBy("chip_id").agg(F.map_from_entries(pairs).alias("assets"))


def asset_inventory(assets: DataFrame, required: Mapping[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """``chip_id, task, missing`` - the required keys a chip lacks."""
    have = assets.groupBy("chip_id").agg(F.collect_set("key").alias("_have"))
    wanted = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    task = task_of(F.col("chip_id"))
    return have.select("chip_id", task.alias("task"), F.array_sort(F.array_except(wanted[task], F.col("_have"))).alias("missing"))


def inventory_report(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("task").agg(
        F.count_if(F.size("missing") == 0).alias("complete"), F.count_if(F.size("missing") > 0).alias("incomplete")
    )


def member_audit(listing: DataFrame, expected: DataFrame, root: str, name: str = "member") -> DataFrame:
    """Missing, repeated, unexpected and unsafe members: ``member, problem``."""
    m = F.col(name)
    unsafe = m.startswith("/") | m.rlike(r"(^|/)\.\.(/|$)") | m.contains("\\") | ~m.startswith(root)
    flagged = listing.where(unsafe).select(name, F.lit("unsafe").alias("problem"))
    counted = listing.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.where("n > 1").select(name, F.lit("repeated").alias("problem"))
    both = counted.withColumn("_have", F.lit(True)).join(expected.select(name).distinct().withColumn("_want", F.lit(True)), name, "full_outer")
    sides = both.select(name, F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").alias("problem")).where("problem is not null")
    return flagged.unionByName(repeated).unionByName(sides)


def checksum_audit(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """``name, state`` for expected files: ok, corrupt, missing or escaping."""
    escape = F.col("name").startswith("/") | F.col("name").rlike(r"(^|/)\.\.(/|$)")
    joined = manifest.select("name", F.lower("sha256").alias("_want")).join(digests.select("name", F.lower("sha256").alias("_got")), "name", "left")
    state = F.when(escape, "escaping").when(F.col("_got").isNull(), "missing").when(F.col("_got") == F.col("_want"), "ok").otherwise("corrupt")
    return joined.select("name", state.alias("state"))


def source_lock(files: DataFrame, url: Column) -> DataFrame:
    """File fingerprints with the sanitised source address."""
    clean, redacted = clean_url(url)
    return files.select("*", clean.alias("source_url"), redacted.alias("url_redacted"))
