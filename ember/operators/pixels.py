"""Between chip tables (arrays) and pixel tables (rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_bands(chips: DataFrame, bands: Sequence[str], width: Column | int, keep: Sequence[str] = ("chip_id",)) -> DataFrame:
    """One row per pixel from per-chip band arrays in C order (narrow)."""
    w = width if isinstance(width, Column) else F.lit(int(width))
    zipped = F.arrays_zip(*[F.col(b) for b in bands])
    return (
        chips.select(*keep, w.cast("bigint").alias("_w"), F.posexplode(zipped).alias("pos", "_px"))
        .select(
            *keep,
            F.col("pos").cast("bigint").alias("pos"),
            F.floor(F.col("pos") / F.col("_w")).cast("bigint").alias("rw"),
            (F.col("pos") % F.col("_w")).cast("bigint").alias("cl"),
            *[F.col("_px")[b].alias(b) for b in bands],
        )
    )


def pack_bands(px: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("chip_id",), order: str = "pos") -> DataFrame:
    """Pixel rows back to one row per chip (a chip is bounded by contract)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *bands)))
    packed = px.groupBy(*keys).agg(rows.alias("_rows"))
    return packed.select(*keys, *[F.col("_rows").getField(b).alias(b) for b in bands])


def label_pixels(masks: DataFrame, label: str, width: Column | int, ignore: int = 255) -> DataFrame:
    """Mask arrays to ``(chip_id, rw, cl, y, labelled)``; 255 becomes NULL."""
    px = explode_bands(masks, [label], width)
    y = F.col(label).cast("int")
    return px.select(
        "chip_id", "rw", "cl", F.when(y != ignore, y).alias("y"), (y != ignore).alias("labelled")
    )


def join_labels(px: DataFrame, labels: DataFrame, keys: Sequence[str] = ("chip_id", "rw", "cl")) -> DataFrame:
    """Features with their labels; both sides shuffle once on the pixel key."""
    return px.join(labels, list(keys), "inner")


def display_mask(px: DataFrame, cls: str = "cls", valid: str = "valid") -> DataFrame:
    """Class where observed, 255 elsewhere."""
    return px.withColumn("mask", F.when(F.col(valid), F.col(cls).cast("int")).otherwise(255))


def features_af(px: DataFrame, height: int, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """The 23 active-fire features in contract order plus ``observed``."""
    from ember.functions import spectral as S
    from ember.operators.focal import focal_means

    carried = ["chip_id", "rw", "cl", *keep]
    i4 = S.finite0(S.over(S.as32("I4") - S.f32(S.KELVIN), 50))
    base = px.select(
        *carried,
        *[c.alias(n) for n, c in {**S.af_scaled(), **S.af_thermal(), **S.af_ratios()}.items()],
        S.af_observed().alias("observed"),
        i4.alias("_i4"),
    )
    focal = focal_means(
        base,
        {"thermal_mean_3": ("I4_minus_I5", 3), "thermal_mean_11": ("I4_minus_I5", 11), "_i4_mean_11": ("_i4", 11)},
        height,
        width,
    )
    for k in (3, 11):
        mean = F.col(f"thermal_mean_{k}").cast("float")
        focal = focal.withColumn(f"thermal_mean_{k}", mean).withColumn(
            f"thermal_contrast_{k}", F.col("I4_minus_I5") - mean
        )
    focal = focal.withColumn("I4_contrast_11", F.col("_i4") - F.col("_i4_mean_11").cast("float"))
    return focal.select(*carried, *af_feature_names(), "observed")


def features_bs(px: DataFrame, height: int, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """The 55 burn-severity features in contract order plus ``observed``."""
    from ember.functions import spectral as S
    from ember.operators.focal import focal_means

    carried = ["chip_id", "rw", "cl", *keep]
    columns = {**S.bs_scaled(), **S.bs_deltas(), **S.bs_indices()}
    base = px.select(*carried, *[c.alias(n) for n, c in columns.items()], S.bs_observed().alias("observed"))
    focal = focal_means(
        base,
        {
            "dNBR_mean_3": ("delta_NBR", 3),
            "dNDVI_mean_3": ("delta_NDVI", 3),
            "dNBR_mean_9": ("delta_NBR", 9),
            "dNDVI_mean_9": ("delta_NDVI", 9),
            "sar_VH_delta_mean_5": ("delta_VH_db", 5),
        },
        height,
        width,
    )
    names = bs_feature_names()
    return focal.select(*carried, *[F.col(n).cast("float").alias(n) for n in names], "observed")


def af_feature_names() -> list[str]:
    """The 23 names in contract order."""
    from ember.functions import spectral as S

    names = [*S.VIIRS, *S.AF_AUX, "I4_minus_I5", "I4_minus_t2m", "I5_minus_t2m", "reflectance_nd21", "reflectance_nd32"]
    for k in (3, 11):
        names += [f"thermal_mean_{k}", f"thermal_contrast_{k}"]
    return [*names, "I4_contrast_11"]


def bs_feature_names() -> list[str]:
    """The 55 names in contract order."""
    from ember.functions import spectral as S

    names = [f"{when}_{band}" for when in ("pre", "post") for band in (*S.OPTICAL, "SCL")]
    names += [f"{when}_{band}_db" for when in ("pre", "post") for band in S.SAR]
    names += [*S.BS_AUX, *[f"delta_{band}" for band in S.OPTICAL], *[f"delta_{band}_db" for band in S.SAR]]
    names += [f"{what}_{index}" for index in S.INDICES for what in ("pre", "post", "delta")]
    for k in (3, 9):
        names += [f"dNBR_mean_{k}", f"dNDVI_mean_{k}"]
    return [*names, "sar_VH_delta_mean_5"]


def to_vector(px: DataFrame, names: Sequence[str], out: str = "features") -> DataFrame:
    """Assemble features in contract order into an ML vector."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="error").transform(px)


def standardise(px: DataFrame, names: Sequence[str], stats: DataFrame) -> DataFrame:
    """Standardise with a one-row table of ``<name>_mean`` / ``<name>_std``.

    The statistics come from ``confusion.fit_normaliser``: one row by
    construction, hence safe to broadcast.
    """
    from ember.functions.spectral import standardised

    mean = {n: F.col(f"{n}_mean") for n in names}
    std = {n: F.col(f"{n}_std") for n in names}
    wide = px.join(F.broadcast(stats), F.lit(True), "inner")
    return wide.select(*[c for c in px.columns if c not in names], *[c.alias(n) for n, c in standardised(list(names), mean, std).items()])
