"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of ``max_epochs`` times its own size.  The
budget is shared by weight; a source that would exceed its cap is held there
and the excess goes to the others by weight, until no source is above its cap.
Inside a source each document is taken ``whole`` times and a seeded subset of
documents fractionally once more, so that the words taken equal the target.

Nulls, ties and repeats: a null source is a source of its own (last in order),
a null text has size 0 and takes nothing, repeated rows are taken like any
other row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ember.llm.common import stored, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source: ``source, weight, source_size, target``.

    ``weights`` repeat over the sources in code-point order, null last.  The
    fill level follows in closed form: sources sorted by cap per weight are
    capped from the front while the level of the rest lies above their ratio.
    The windows see one row per source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(max_epochs)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rows = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = rows.rowsBetween(Window.unboundedPreceding, -1), rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    budget = F.sum("source_size").over(everything) * float(share)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("_level", level).withColumn("_held", F.col("_level") >= F.col("_ratio"))
    free = levelled.withColumn("_fill", F.min(F.struct((F.col("_held").cast("int")).alias("h"), F.col("_ratio").alias("r"), F.col("_level").alias("l"))).over(everything))
    # the first source that stays below its cap sets the level of all that follow
    target = F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("weight") * F.col("_fill.l"))
    return free.select("source", "weight", "source_size", target.alias("target"))


def seeded_key(seed: int, *parts: Column) -> Column:
    """Reproducible hexadecimal sorting key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def source_cuts(narrow: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Per source its target, full repetitions and the key at which the last one ends.

    ``narrow`` has ``source, key, size``.  The seeded order is cut in two levels:
    sums per source and 16-bit key bucket (combined before the shuffle) find the
    bucket of the cut; only keys of that one bucket are put in order.
    """
    buckets = narrow.groupBy("source", F.substring("key", 1, 4).alias("bucket")).agg(F.sum("size").alias("_words"))
    sizes = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("_left", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(running), F.lit(0)))
    spans = spans.join(targets.select(F.col("source").alias("_source"), "_left"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    spans = spans.where("_start < _left and _start + _words >= _left")
    near = narrow.withColumn("bucket", F.substring("key", 1, 4)).alias("n").join(
        spans.alias("s"),
        F.col("n.source").eqNullSafe(F.col("s.source")) & (F.col("n.bucket") == F.col("s.bucket")),
    )
    keys = near.groupBy(F.col("n.source").alias("source"), "key").agg(
        F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"), F.max("_start").alias("_start"), F.max("_left").alias("_left")
    )
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    keys = keys.where("_before < _left and _before + _words >= _left").select(
        F.col("source").alias("_source"),
        F.col("key").alias("cut_key"),
        F.floor((F.col("_left") - F.col("_before")) / F.col("_rows")).alias("cut_words"),
        ((F.col("_left") - F.col("_before")) * 2 >= F.col("_words")).alias("cut_whole"),
    )
    return targets.join(keys, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_left")


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = seeded_key(seed, F.col("doc_id"), F.md5(text.cast("binary")))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"))


def _salted(cuts: DataFrame) -> DataFrame:
    """One copy of a source's row per first digit of a key, so that a hot source spreads."""
    return cuts.withColumn("_salt", F.explode(F.array(*[F.lit(d) for d in "0123456789abcdef"])))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Words each document gives to the mix.

    Returns ``doc_id, key, source, size, source_size, target, whole, extra, taken``:
    ``whole`` full repetitions and ``extra`` more words (a full repetition for
    documents before the cut of the seeded order, part of one at the cut, where
    rows of one key share evenly).  ``taken = whole * size + extra``; its sum
    over a source is the rounded target.  The text is read once; everything
    after works on the written narrow rows.
    """
    narrow = stored(_narrow(docs, seed), "mix")
    cuts = _salted(source_cuts(narrow, weights, share, max_epochs).withColumnRenamed("source", "_source"))
    placed = narrow.join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.substring("key", 1, 1) == F.col("_salt")))
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least("size", "cut_words")).otherwise(0).cast("bigint")
    placed = placed.withColumn("extra", extra).withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint"))
    return placed.select("doc_id", "key", "source", "size", "source_size", "target", "whole", "extra", "taken")


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.

    A repetition split by the cut counts when at least half of it is taken,
    since a text is kept whole or not at all.  Columns are those of ``docs``.
    """
    cuts = source_cuts(stored(_narrow(docs, seed), "mix"), weights, share, max_epochs)
    names = {"source": "__source", "whole": "__whole", "cut_key": "__cut", "cut_whole": "__full"}
    cuts = _salted(cuts.select(*[F.col(c).alias(n) for c, n in names.items()])).withColumnRenamed("_salt", "__salt")
    key = seeded_key(seed, docs["doc_id"], F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    placed = docs.join(cuts, docs["source"].cast("string").eqNullSafe(F.col("__source")) & (F.substring(key, 1, 1) == F.col("__salt")))
    more = (key < F.col("__cut")) | ((key == F.col("__cut")) & F.col("__full"))
    times = F.col("__whole").cast("int") + F.coalesce(more, F.lit(False)).cast("int")
    repeated = placed.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), times)).alias("__copy"))
    return repeated.drop("__copy")
