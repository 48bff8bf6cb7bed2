"""Per-pixel band arithmetic as Columns (float32, like the imagery itself).

Spark keeps ``float +,-,* float`` in float32 and divides in float64; casting
the quotient back gives the correctly rounded float32 division.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names and scene-classification codes of the chip format.
OPTICAL = ("B2", "B3", "B4", "B5", "B6", "B7", "B8A", "B11", "B12")
VIIRS = ("I1", "I2", "I3", "I4", "I5", "solar_zenith", "sensor_zenith", "valid")
AF_AUX = ("landcover", "dem", "t2m", "rh2m", "wind_speed")
SAR = ("VV", "VH")
BS_AUX = ("dem", "slope", "landcover")
UNUSABLE_SCL = (0, 1, 3, 8, 9, 10, 11)
KELVIN = 273.15
# Index name -> the two optical bands it contrasts.
INDICES = {"NBR": ("B8A", "B12"), "NDVI": ("B8A", "B4"), "NBR2": ("B11", "B12"), "NDWI": ("B3", "B8A")}


def f32(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def as32(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("float")


def over(value: Column, divisor: float) -> Column:
    """float32 division by a constant."""
    return (value / F.lit(float(divisor))).cast("float")


def is_finite(value: Column) -> Column:
    """Spark orders NaN above infinity, so one comparison excludes both."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def finite0(value: Column) -> Column:
    """Replace NULL, NaN and infinities by zero."""
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(f32(0.0))


def norm_diff(a: Column, b: Column) -> Column:
    """Normalised difference in [-1, 1]; NaN and NULL pass through.

    ``|a - b| <= |a| + |b|`` survives rounding, so the quotient cannot leave
    the interval and needs no clipping.
    """
    return ((a - b) / (F.abs(a) + F.abs(b) + f32(1e-5))).cast("float")


def _celsius50(value: Column) -> Column:
    return over(value - f32(KELVIN), 50)


def af_scaled() -> dict[str, Column]:
    """The 13 scaled instrument and auxiliary bands of an active-fire pixel."""
    divisors = {"landcover": 100, "dem": 1000, "rh2m": 100, "wind_speed": 20, "solar_zenith": 90, "sensor_zenith": 90}
    out: dict[str, Column] = {}
    for name in (*VIIRS, *AF_AUX):
        band = as32(name)
        if name in ("I4", "I5", "t2m"):
            band = _celsius50(band)
        elif name in divisors:
            band = over(band, divisors[name])
        out[name] = finite0(band)
    return out


def af_thermal() -> dict[str, Column]:
    """Thermal contrasts; the I4-I5 gap is cleansed before it is scaled."""
    i4, i5, air = as32("I4"), as32("I5"), as32("t2m")
    return {
        "I4_minus_I5": over(finite0(i4 - i5), 20),
        "I4_minus_t2m": finite0(over(i4 - air, 20)),
        "I5_minus_t2m": finite0(over(i5 - air, 20)),
    }


def af_ratios() -> dict[str, Column]:
    return {
        "reflectance_nd21": finite0(norm_diff(as32("I2"), as32("I1"))),
        "reflectance_nd32": finite0(norm_diff(as32("I3"), as32("I2"))),
    }


def af_observed() -> Column:
    """Pixel was observed: five finite imagery bands and a set validity flag."""
    usable = is_finite(as32("valid")) & (as32("valid") > 0.5)
    for name in VIIRS[:5]:
        usable = usable & is_finite(as32(name))
    return usable


def bs_reflectance() -> dict[str, Column]:
    """Optical bands as reflectance, keyed ``pre_B2`` ... ``post_B12``."""
    return {f"{when}_{band}": over(as32(f"{when}_{band}"), 10000) for when in ("pre", "post") for band in OPTICAL}


def bs_scaled() -> dict[str, Column]:
    """20 optical, 4 radar and 3 terrain features of a burn-severity pixel."""
    out: dict[str, Column] = {}
    for when in ("pre", "post"):
        for band in OPTICAL:
            out[f"{when}_{band}"] = finite0(over(as32(f"{when}_{band}"), 10000))
        out[f"{when}_SCL"] = finite0(over(as32(f"{when}_SCL"), 11))
    for when in ("pre", "post"):
        for band in SAR:
            out[f"{when}_{band}_db"] = finite0(over(over(as32(f"{when}_{band}"), 100), 30))
    for name, divisor in zip(BS_AUX, (1000, 90, 100)):
        out[name] = finite0(over(as32(name), divisor))
    return out


def bs_deltas() -> dict[str, Column]:
    """Pre-minus-post differences of reflectance and radar backscatter."""
    refl = bs_reflectance()
    out = {f"delta_{band}": finite0(refl[f"pre_{band}"] - refl[f"post_{band}"]) for band in OPTICAL}
    for band in SAR:
        gap = over(as32(f"pre_{band}"), 100) - over(as32(f"post_{band}"), 100)
        out[f"delta_{band}_db"] = finite0(over(gap, 20))
    return out


def bs_indices() -> dict[str, Column]:
    """NBR, NDVI, NBR2 and NDWI before, after and their drop."""
    refl = bs_reflectance()
    out: dict[str, Column] = {}
    for name, (first, second) in INDICES.items():
        pre = norm_diff(refl[f"pre_{first}"], refl[f"pre_{second}"])
        post = norm_diff(refl[f"post_{first}"], refl[f"post_{second}"])
        out[f"pre_{name}"] = finite0(pre)
        out[f"post_{name}"] = finite0(post)
        out[f"delta_{name}"] = finite0(pre - post)
    return out


def bs_observed() -> Column:
    """All optical values finite and neither date classified as unusable."""
    usable = F.lit(True)
    for when in ("pre", "post"):
        for band in (*OPTICAL, "SCL"):
            usable = usable & is_finite(as32(f"{when}_{band}"))
        usable = usable & ~F.col(f"{when}_SCL").cast("int").isin(*UNUSABLE_SCL)
    return F.coalesce(usable, F.lit(False))


def standardised(names: list[str], mean: Mapping[str, Column], std: Mapping[str, Column]) -> dict[str, Column]:
    """``(x - mean) / std`` with non-finite values set to the mean first."""
    return {
        name: ((F.when(is_finite(F.col(name)), F.col(name)).otherwise(mean[name]) - mean[name]) / std[name])
        for name in names
    }
