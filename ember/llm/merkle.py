"""Merkle manifest of a table of documents, with a proof per row.

Every row becomes a leaf, the leaves of a source form a tree of fan-out 16, and
the sources' roots form one more tree.  The work is cut into superblocks of
16^3 consecutive leaves of a source:

1. leaves are hashed by built-in functions and numbered inside their source
   through a range partitioning, so that a source may hold any share of rows;
2. every superblock is reduced to one node;
3. the few nodes above superblocks are reduced level by level, which gives each
   superblock the runs that it needs from outside;
4. leaves and these outer runs are cogrouped by superblock: one pass reduces
   locally, joins the proof and folds the presented leaf up to the root.

No text leaves the scan of step 1; a group of step 2 or 4 has at most 4096 rows.

Nulls, ties and repeats: a null field hashes as ``-``; a null ``doc_id`` comes
first inside its source, a null source before all others; rows with one id are
ordered by leaf, and equal rows are leaves of their own.  Other columns of the
input are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.llm.common import stored

#: Nodes that become one node of the next level.
FAN = 16
#: Levels inside a superblock.
INNER = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PROVED = "doc_id string, leaf string, subroot string, root string, proof array<string>, path array<int>, folded_root string, verified boolean"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_text(docs: DataFrame) -> dict[str, Column]:
    """The tampering of the check: A-Z lower-cased where 5 divides the crc32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))}


def leaf_hash(values: Mapping[str, Column]) -> Column:
    """Digest of a row's fields, each as byte count, colon and value."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels(n: int) -> int:
    """Reductions until one of ``n`` nodes remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``size`` inside their group, in the given order.

    The rows are sorted once over a range partitioning of group and order; what
    precedes a partition inside its group follows from counts per partition.  A
    group may span any number of partitions.
    """
    sort = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    spread = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(spread, name).withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("size")
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = kept.join(counts, same).withColumn("pos", F.col("_at") + F.col("_shift"))
    return placed.select(*rows.columns, "pos", "size")


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def _reduced(nodes: list[str], depth: int) -> list[list[str]]:
    """Joined runs of every level; after the last level one node would remain."""
    out = []
    for _ in range(depth):
        runs = ["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(runs)
        nodes = [_digest(r) for r in runs]
    return out


def _subtrees(frame: pd.DataFrame, inner: int) -> Iterator[tuple[tuple[int, int], pd.DataFrame, int]]:
    """Superblocks of a group with the levels they are reduced by."""
    frame = frame.sort_values(["s_no", "pos"], kind="stable")
    for key, rows in frame.groupby(["s_no", "block"], sort=False):
        yield key, rows, min(inner, levels(int(rows["size"].iloc[0])))


def _block_roots(inner: int):
    def roots(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (s_no, block), rows, depth in _subtrees(frame, inner):
            runs = _reduced(rows["leaf"].tolist(), depth)
            out.append((frame["bundle"].iloc[0], s_no, block, int(rows["size"].iloc[0]), _digest(runs[-1][0]) if runs else rows["leaf"].iloc[0]))
        return pd.DataFrame(out, columns=["bundle", "s_no", "block", "size", "h"])

    return roots


def _proved(inner: int):
    """Local reduction, proof and fold of the leaves of a group of superblocks."""

    def proved(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        outside = {(r.s_no, r.block): r for r in outer.itertuples(index=False)}
        out = []
        for key, rows, depth in _subtrees(frame, inner):
            above = outside[key]
            local = _reduced(rows["leaf"].tolist(), depth)
            over = [(int(m), r) for m, r in zip(above.places, above.runs)]
            first = key[1] * FAN**inner
            for doc_id, pos, leaf, shown in zip(rows["doc_id"], rows["pos"], rows["leaf"], rows["shown"]):
                at, folded, proof, path, steps = int(pos) - first, shown, [], [], []
                for runs in local:
                    steps.append((at % FAN, runs[at // FAN]))
                    at //= FAN
                for me, run in (*steps, *over):
                    left, right = run[: 64 * me], run[64 * (me + 1) :]
                    proof.append(left + right)
                    path.append(me)
                    folded = _digest(left + folded + right)
                out.append((doc_id, leaf, above.subroot, above.root, proof, path, folded, folded == above.root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof", "path", "folded_root", "verified"])

    return proved


def climbed(nodes: DataFrame, depth: int) -> DataFrame:
    """Runs from every node of ``g, idx, size, h`` up to the top of its group.

    Returns ``g, idx, places, runs, top``: the node's ancestors' places in their
    runs and the joined runs, lowest first.  ``depth`` bounds the levels; a run
    has at most 16 nodes.
    """
    out = nodes.select("g", "idx", F.col("idx").alias("_at"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("runs"), F.col("h").alias("top"))
    current = nodes.select("g", "idx", "size", "h")
    for _ in range(depth):
        members = F.array_sort(F.collect_list(F.struct("idx", "h")))
        runs = current.where("size > 1").groupBy("g", F.expr(f"idx div {FAN}").alias("_run"), "size").agg(F.array_join(F.transform(members, lambda m: m["h"]), "").alias("_joined"))
        runs = stored(runs.withColumn("_h", F.sha2("_joined", 256)), "runs")
        current = runs.select("g", F.col("_run").alias("idx"), F.ceil(F.col("size") / FAN).cast("bigint").alias("size"), F.col("_h").alias("h"))
        match = runs.select(F.col("g").alias("_g"), "_run", "_joined", "_h")
        out = out.withColumn("_up", F.expr(f"_at div {FAN}")).join(match, (F.col("g") == F.col("_g")) & (F.col("_up") == F.col("_run")), "left")
        found = F.col("_run").isNotNull()
        out = out.select(
            "g",
            "idx",
            F.col("_up").alias("_at"),
            F.when(found, F.concat("places", F.array((F.col("_at") % FAN).cast("int")))).otherwise(F.col("places")).alias("places"),
            F.when(found, F.concat("runs", F.array("_joined"))).otherwise(F.col("runs")).alias("runs"),
            F.coalesce("_h", "top").alias("top"),
        )
    return out.drop("_at")


def manifest(docs: DataFrame, presented: Mapping[str, Column] | None = None, inner: int = INNER) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from what is presented.

    ``presented`` replaces fields of the row to be verified (nothing by
    default).  Returns ``doc_id, leaf, subroot, root, proof, path, folded_root,
    verified``: ``proof`` has the joined sibling digests of each level, ``path``
    the row's own place among them.  A superblock has ``16 ** inner`` leaves;
    sources of at most a 64th of that share a group with their neighbours.
    """
    span = FAN**inner
    few = max(1, span // 64)
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_hash(fields).alias("leaf"),
        leaf_hash(fields | dict(presented or {})).alias("shown"),
    )
    # equal rows are told apart by a number of the written rows, so that ranges can split them
    rows = stored(rows, "leaves").withColumn("_tie", F.monotonically_increasing_id())
    rows = numbered(rows, ["source"], ["doc_id", "leaf", "_tie"], "numbered")
    sources = rows.where("pos = 0").select("source")
    sources = stored(numbered(sources, [], ["source"], "sources").select(F.col("source").alias("_source"), F.col("pos").alias("s_no"), F.col("size").alias("n_sources")), "sources")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    small = F.col("size") <= few
    rows = rows.select(
        F.when(small, -1 - F.expr(f"s_no div {few}")).otherwise(F.col("s_no")).alias("bundle"),
        F.expr(f"pos div {span}").alias("block"),
        F.col("doc_id").cast("string").alias("doc_id"),  # pandas keeps no whole numbers beside nulls
        *("s_no", "pos", "size", "leaf", "shown"),
    )
    rows = stored(rows, "superblocks")

    blocks = rows.groupBy("bundle", "block").applyInPandas(_block_roots(inner), "bundle bigint, s_no bigint, block bigint, size bigint, h string")
    blocks = stored(blocks, "blocks")
    most, count = blocks.agg(F.max("block"), F.max("s_no")).first()
    if most is None:
        return docs.sparkSession.createDataFrame([], PROVED).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    above = climbed(blocks.select(F.col("s_no").alias("g"), F.col("block").alias("idx"), F.ceil(F.col("size") / span).cast("bigint").alias("size"), "h"), levels(most + 1))
    above = stored(above, "above")
    subroots = above.where("idx = 0").select(F.lit(0).alias("g"), F.col("g").alias("idx"), F.lit(count + 1).cast("bigint").alias("size"), F.col("top").alias("h"))
    over = climbed(subroots, levels(count + 1)).select(F.col("idx").alias("_s"), F.col("places").alias("_places"), F.col("runs").alias("_runs"), F.col("top").alias("root"))
    outer = above.join(over, F.col("g") == F.col("_s")).select(
        F.col("g").alias("s_no"), F.col("idx").alias("block"), F.concat("places", "_places").alias("places"), F.concat("runs", "_runs").alias("runs"), F.col("top").alias("subroot"), "root"
    )
    keys = blocks.select(F.col("s_no").alias("_s_no"), F.col("block").alias("_block"), "bundle")
    outer = outer.join(keys, (F.col("s_no") == F.col("_s_no")) & (F.col("block") == F.col("_block"))).drop("_s_no", "_block")
    done = rows.groupBy("bundle", "block").cogroup(outer.groupBy("bundle", "block"))
    return done.applyInPandas(_proved(inner), PROVED).withColumn("doc_id", F.col("doc_id").cast("bigint"))
