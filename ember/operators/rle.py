"""Run-length masks: one-based starts, C order, maximal runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = "struct<start:bigint,len:bigint>"


def runs(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """Maximal runs per class: ``(keys, cls, start, len)``, starts zero-based.

    Two levels: islands inside one image row (one exchange on chip and row),
    then runs that continue across a row boundary are joined up - on data that
    has already shrunk from pixels to runs.
    """
    keys = list(keys)
    marked = px.where(F.col(cls) > 0).select(*keys, "rw", "pos", F.col(cls).cast("int").alias("cls"))
    in_row = Window.partitionBy(*keys, "rw", "cls").orderBy("pos")
    pieces = (
        marked.withColumn("_g", F.col("pos") - F.row_number().over(in_row))
        .groupBy(*keys, "rw", "cls", "_g")
        .agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("len"))
    )
    in_chip = Window.partitionBy(*keys, "cls").orderBy("start")
    fresh = F.coalesce((F.lag(F.col("start") + F.col("len")).over(in_chip) != F.col("start")).cast("int"), F.lit(1))
    tagged = pieces.withColumn("_new", fresh)
    numbered = tagged.withColumn("_run", F.sum("_new").over(in_chip.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "cls", "_run").agg(F.min("start").alias("start"), F.sum("len").alias("len")).drop("_run")


def _join_runs(pairs: Column) -> Column:
    """Ordered pairs of zero-based runs to text."""
    return F.array_join(
        F.transform(pairs, lambda p: F.concat((p["start"] + 1).cast("string"), F.lit(" "), p["len"].cast("string"))), " "
    )


def rle_encode(px: DataFrame, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """``(keys, class_id, rle)`` for every class that occurs."""
    found = runs(px, keys, cls)
    packed = found.groupBy(*keys, F.col("cls").alias("class_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "len"))).alias("_p")
    )
    return packed.select(*keys, "class_id", _join_runs(F.col("_p")).alias("rle"))


def rle_encode_classes(px: DataFrame, classes: Sequence[int], keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """One row per chip and listed class; absent classes give the empty text."""
    chips = px.select(*keys).distinct().select("*", F.explode(F.array(*map(F.lit, classes))).alias("class_id"))
    return chips.join(rle_encode(px, keys, cls), [*keys, "class_id"], "left").withColumn("rle", F.coalesce("rle", F.lit("")))


def rle_of_array(mask: Column, cls: int) -> Column:
    """RLE of one class straight from a C-order array column (no shuffle)."""
    index = F.sequence(F.lit(0), F.size(mask) - 1)
    here = lambda i: F.get(mask, i) == cls
    starts = F.filter(index, lambda i: here(i) & ~F.coalesce(F.get(mask, i - 1) == cls, F.lit(False)))
    stops = F.filter(index, lambda i: here(i) & ~F.coalesce(F.get(mask, i + 1) == cls, F.lit(False)))
    return F.array_join(
        F.zip_with(starts, stops, lambda a, b: F.concat((a + 1).cast("string"), F.lit(" "), (b - a + 1).cast("string"))), " "
    )


def tokens(rle: Column) -> Column:
    return F.filter(F.split(rle, r"\s+"), lambda t: t != "")


def pairs(rle: Column) -> Column:
    """Text to an array of zero-based ``start, len`` pairs (one linear pass)."""
    parts = tokens(rle)
    starts = F.filter(parts, lambda _t, i: i % 2 == 0)
    lengths = F.filter(parts, lambda _t, i: i % 2 == 1)
    return F.zip_with(
        starts, lengths, lambda a, b: F.struct((a.try_cast("bigint") - 1).alias("start"), b.try_cast("bigint").alias("len"))
    )


def rle_decode(df: DataFrame, width: Column | int, rle: str = "rle") -> DataFrame:
    """One row per set pixel: all other columns plus ``pos, rw, cl``."""
    w = width if isinstance(width, Column) else F.lit(int(width))
    others = [c for c in df.columns if c != rle]
    spans = df.select(*others, w.alias("_w"), F.inline(pairs(F.col(rle))))
    px = spans.where("len > 0").select(*others, "_w", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    return px.select(
        *others, "pos", F.floor(F.col("pos") / F.col("_w")).cast("bigint").alias("rw"), (F.col("pos") % F.col("_w")).cast("bigint").alias("cl")
    )


# Broken rules in order of precedence; the fold below keeps the smallest index.
RLE_RULES = (
    "missing", "odd tokens", "not an integer", "start below one", "empty run", "beyond the mask",
    "unordered, overlapping or adjacent", "not canonical text",
)


def rle_problem(rle: Column, size: Column) -> Column:
    """First broken rule of a canonical mask text, NULL when it is canonical.

    A single fold over the tokens: state is the token number, the open start,
    the previous end and the smallest broken rule so far.
    """
    fine = len(RLE_RULES)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.lit(fine).alias("rule"), F.lit(True).alias("plain")
    )

    def step(acc: Column, token: Column) -> Column:
        value = token.try_cast("bigint")
        is_start = acc["i"] % 2 == 0
        stop = acc["start"] + value
        rule = (
            F.when(value.isNull(), 2)
            .when(is_start & (value < 1), 3)
            .when(~is_start & (value <= 0), 4)
            .when(~is_start & (stop > size), 5)
            .when(~is_start & (acc["start"] <= acc["end"]), 6)
            .otherwise(fine)
        )
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(is_start, F.coalesce(value, F.lit(1)) - 1).otherwise(acc["start"]).alias("start"),
            F.when(is_start, acc["end"]).otherwise(F.coalesce(stop, acc["end"])).alias("end"),
            F.least(acc["rule"], rule).alias("rule"),
            (acc["plain"] & F.coalesce(value.cast("string") == token, F.lit(False))).alias("plain"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["i"] % 2 == 1, 1).when(acc["rule"] < fine, acc["rule"]).when(~acc["plain"], 7)

    found = F.aggregate(tokens(rle), start, step, finish)
    spacing = (F.length(rle) != F.length(F.trim(rle))) | rle.rlike(r"\s\s|[\t\r\n]")
    code = F.when(rle.isNull() | F.lower(rle).isin("nan", "null", "none"), 0).otherwise(F.coalesce(found, F.when(spacing, 7)))
    return F.get(F.array(*map(F.lit, RLE_RULES)), code)


def rle_violations(df: DataFrame, height: Column | int, width: Column | int, rle: str = "rle") -> DataFrame:
    size = (height if isinstance(height, Column) else F.lit(int(height))) * (width if isinstance(width, Column) else F.lit(int(width)))
    return df.withColumn("problem", rle_problem(F.col(rle), size)).where(F.col("problem").isNotNull())


def check_runs(run_table: DataFrame, keys: Sequence[str] = ("chip_id", "cls")) -> DataFrame:
    """Runs that start at or before the end of the previous run."""
    w = Window.partitionBy(*keys).orderBy("start", "len")
    before = F.lag(F.col("start") + F.col("len")).over(w)
    return run_table.withColumn("prev_end", before).where(F.col("start") <= F.col("prev_end"))


def overlapping_pixels(px: DataFrame, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """Pixels claimed by more than one class."""
    return px.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def rle_decode_classes(df: DataFrame, width: Column | int) -> tuple[DataFrame, DataFrame]:
    """Severity masks to class pixels, and the pixels that break exclusivity."""
    px = rle_decode(df, width).withColumnRenamed("class_id", "cls")
    return px, overlapping_pixels(px)


def rle_round_trip(px: DataFrame, width: Column | int, keys: Sequence[str] = ("chip_id",), cls: str = "cls") -> DataFrame:
    """Pixels that encoding and decoding loses or invents."""
    wanted = px.where(F.col(cls) > 0).select(*keys, "pos", F.col(cls).cast("int").alias("class_id"))
    got = rle_decode(rle_encode(px, keys, cls), width).select(*keys, "pos", F.col("class_id").cast("int").alias("class_id"))
    lost = wanted.exceptAll(got).withColumn("side", F.lit("lost"))
    return lost.unionByName(got.exceptAll(wanted).withColumn("side", F.lit("invented")))


def register_rle_udtf(spark) -> None:
    """SQL table function ``rle_pixels(rle, width)`` -> (pos, rw, cl).

    A SQL function over ``sequence``: it is inlined into the calling plan, so no
    Python worker sees a pixel.
    """
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION rle_pixels(rle STRING, width BIGINT)
        RETURNS TABLE (pos BIGINT, rw BIGINT, cl BIGINT)
        RETURN SELECT pos, pos DIV width, pos % width FROM (
          SELECT explode(sequence(CAST(t[2 * i] AS BIGINT) - 1, CAST(t[2 * i] AS BIGINT) + CAST(t[2 * i + 1] AS BIGINT) - 2)) AS pos
          FROM (SELECT t, explode(sequence(0, size(t) DIV 2 - 1)) AS i FROM (SELECT split(trim(rle), ' +') AS t) WHERE size(t) > 1))
    """)
