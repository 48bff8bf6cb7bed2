"""Expose the scalar formulas to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ember.functions.projection import A, CEA_K0, E, E2

SQL_FUNCTIONS = {
    "norm_diff": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN greatest(least((a - b) / (abs(a) + abs(b) + 1e-5D), 1D), -1D)",
    "f1_score": "(tp BIGINT, fp BIGINT, fn BIGINT) RETURNS DOUBLE RETURN "
    "CASE WHEN 2 * tp + fp + fn = 0 THEN 1D ELSE 2D * tp / (2 * tp + fp + fn) END",
    "iou_score": "(inter BIGINT, uni BIGINT) RETURNS DOUBLE RETURN CASE WHEN uni = 0 THEN 1D ELSE inter * 1D / uni END",
    "cea_x": f"(lon DOUBLE) RETURNS DOUBLE RETURN {A * CEA_K0!r}D * radians(lon)",
    "cea_y": f"(lat DOUBLE) RETURNS DOUBLE RETURN {A / (2 * CEA_K0)!r}D * {1 - E2!r}D * (sin(radians(lat)) "
    f"/ (1D - {E2!r}D * pow(sin(radians(lat)), 2)) - {1 / (2 * E)!r}D "
    f"* ln((1D - {E!r}D * sin(radians(lat))) / (1D + {E!r}D * sin(radians(lat)))))",
    "bbox_area_ha": "(w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN "
    "(cea_x(e) - cea_x(w)) * (cea_y(n) - cea_y(s)) / 10000D",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
