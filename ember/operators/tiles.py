"""Rotations, mirrors and crops as coordinate algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ember.operators.indexing import draw

# The eight symmetries as (quarter turns, mirrored).
D4 = tuple((turns, mirror) for mirror in (False, True) for turns in range(4))


def rotate(rw: Column, cl: Column, height: Column, width: Column, turns: int) -> tuple[Column, Column]:
    """Where a pixel lands after counter-clockwise quarter turns."""
    turns %= 4
    if turns == 1:
        return width - 1 - cl, rw
    if turns == 2:
        return height - 1 - rw, width - 1 - cl
    if turns == 3:
        return cl, height - 1 - rw
    return rw, cl


def transform_pixel(rw, cl, height, width, turns: int, mirror: bool) -> tuple[Column, Column]:
    """Rotate, then mirror left-right."""
    r, c = rotate(rw, cl, height, width, turns)
    turned_width = height if turns % 2 else width
    return (r, turned_width - 1 - c) if mirror else (r, c)


def restore_pixel(r, c, height, width, turns: int, mirror: bool) -> tuple[Column, Column]:
    """Inverse of :func:`transform_pixel`; sizes are those of the original."""
    turned_height, turned_width = (width, height) if turns % 2 else (height, width)
    if mirror:
        c = turned_width - 1 - c
    return rotate(r, c, turned_height, turned_width, -turns)


def _sizes(height: Column | int, width: Column | int) -> tuple[Column, Column]:
    return tuple(v if isinstance(v, Column) else F.lit(int(v)) for v in (height, width))


def augment(px: DataFrame, height: Column | int, width: Column | int, flip_h: bool, flip_v: bool, turns: int) -> DataFrame:
    """Left-right flip, then up-down flip, then quarter turns."""
    h, w = _sizes(height, width)
    cl = w - 1 - F.col("cl") if flip_h else F.col("cl")
    rw = h - 1 - F.col("rw") if flip_v else F.col("rw")
    r, c = rotate(rw, cl, h, w, turns)
    return px.withColumns({"rw": r.cast("bigint"), "cl": c.cast("bigint")})


def d4_variants(px: DataFrame, height: Column | int, width: Column | int) -> DataFrame:
    """Eight transformed copies of every pixel, tagged ``turns, mirror``."""
    h, w = _sizes(height, width)
    places = []
    for turns, mirror in D4:
        r, c = transform_pixel(F.col("rw"), F.col("cl"), h, w, turns, mirror)
        places.append(
            F.struct(
                F.lit(turns).alias("turns"),
                F.lit(mirror).alias("mirror"),
                r.cast("bigint").alias("rw"),
                c.cast("bigint").alias("cl"),
            )
        )
    others = [c for c in px.columns if c not in ("rw", "cl")]
    return px.select(*others, F.inline(F.array(*places)))


def d4_average(scored: DataFrame, scores: Sequence[str], height: Column | int, width: Column | int, keys: Sequence[str] = ("chip_id",)) -> DataFrame:
    """Mean score per original pixel over variants tagged ``turns, mirror``."""
    h, w = _sizes(height, width)
    row = col = None
    for turns, mirror in D4:
        r, c = restore_pixel(F.col("rw"), F.col("cl"), h, w, turns, mirror)
        here = (F.col("turns") == turns) & (F.col("mirror") == mirror)
        row = F.when(here, r) if row is None else row.when(here, r)
        col = F.when(here, c) if col is None else col.when(here, c)
    placed = scored.select(*keys, row.cast("bigint").alias("_r"), col.cast("bigint").alias("_c"), *scores)
    return (
        placed.groupBy(*keys, F.col("_r").alias("rw"), F.col("_c").alias("cl"))
        .agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in scores])
    )


def crop_windows(px: DataFrame, height: int, width: int, size: int, seed: int, classes: Sequence[int] = (1, 2, 3), centred: int = 70) -> DataFrame:
    """One crop per chip: ``(chip_id, top, left)``.

    With probability ``centred`` percent the crop is centred on a pixel of a
    uniformly chosen present class, clamped to the chip; otherwise it is
    uniform.  All draws are digests of seed and chip, so the choice does not
    depend on partitioning.  Per class the winning pixel is the one with the
    smallest digest, then position: a struct minimum, combined map-side.
    """
    counts = px.select("chip_id", "rw", "cl", "y", "valid")
    picks = counts.groupBy("chip_id").agg(
        *[
            F.min(
                F.when(
                    (F.col("y") == c) & F.col("valid"),
                    F.struct(draw(seed, F.col("chip_id"), F.lit(c), F.col("rw"), F.col("cl")).alias("draw"), "rw", "cl"),
                )
            ).alias(f"_p{c}")
            for c in classes
        ]
    )
    present = F.array_compact(F.array(*[F.col(f"_p{c}") for c in classes]))
    chip = F.col("chip_id")
    chosen = F.col("_present")[F.pmod(draw(seed, chip, F.lit("class")), F.size("_present")).cast("int")]
    use = (F.size("_present") > 0) & (F.pmod(draw(seed, chip, F.lit("centre")), F.lit(100)) < centred)

    def clamp(at: Column, extent: int) -> Column:
        return F.greatest(F.lit(0), F.least(at - size // 2, F.lit(extent - size)))

    top = F.when(use, clamp(F.col("_pixel.rw"), height)).otherwise(
        F.pmod(draw(seed, chip, F.lit("top")), F.lit(height - size + 1))
    )
    left = F.when(use, clamp(F.col("_pixel.cl"), width)).otherwise(
        F.pmod(draw(seed, chip, F.lit("left")), F.lit(width - size + 1))
    )
    return (
        picks.withColumn("_present", present)
        .withColumn("_pixel", F.when(F.size("_present") > 0, chosen))
        .select("chip_id", top.cast("bigint").alias("top"), left.cast("bigint").alias("left"))
    )


def crop(px: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Pixels inside each chip's crop, re-based to the crop's corner."""
    joined = px.join(windows, "chip_id")
    inside = (F.col("rw") >= F.col("top")) & (F.col("rw") < F.col("top") + size) & (F.col("cl") >= F.col("left")) & (F.col("cl") < F.col("left") + size)
    return (
        joined.where(inside)
        .withColumns({"rw": F.col("rw") - F.col("top"), "cl": F.col("cl") - F.col("left")})
        .drop("top", "left")
    )
