"""Writers and their readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_MARK = "\\N"


def write_features(px: DataFrame, path: str) -> None:
    """Feature pixels partitioned by task and split (pruned on read)."""
    px.repartition("task", "split", "chip_id").write.mode("overwrite").partitionBy("task", "split").parquet(path)


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.groupBy("task", "split").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("chip_id").alias("chips"))


def write_probs(px: DataFrame, path: str) -> None:
    """Score cache: one folder per task, rows clustered by chip."""
    px.repartition("task", "chip_id").sortWithinPartitions("chip_id").write.mode("overwrite").partitionBy("task").parquet(path)


def read_probs(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    cache = spark.read.parquet(path)
    return cache if task is None else cache.where(F.col("task") == task)


def write_submission(sub: DataFrame, path: str, single_file: bool = False) -> None:
    """Quoted CSV in template order, empty masks as empty text.

    Range-sorted part files by default; their concatenation in name order is the
    submission.  ``single_file`` sends all rows (one per chip and class) through
    one task, for consumers that read one file only.
    """
    ordered = sub.orderBy("template_pos").select("chip_id", "class_id", "rle")
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue="")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="chip_id string, class_id int, rle string", emptyValue="", nullValue=NULL_MARK)


def geojson_features(df: DataFrame, geometry: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON Feature text per row; ``geometry`` is a struct column."""
    body = F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited Features, readable as a sequence by GIS tools."""
    features.select("value").write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, order: str) -> DataFrame:
    """Lines ``pos, order, value`` of one FeatureCollection: head, Features, foot.

    Features are put in order of ``order`` (equal lines once); all but the first
    carry a comma in front.  Sorted by ``pos`` and ``order`` the lines are one document.
    """
    lines = features.select(F.col(order).alias("order"), "value").distinct()
    first = lines.agg(F.min(F.struct("order", "value")).alias("_first"))
    mark = F.when(F.struct("order", "value") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    body = lines.join(F.broadcast(first), F.lit(True)).select(F.lit(1).alias("pos"), "order", F.concat(mark, "value").alias("value"))
    kind = dict(lines.dtypes)["order"]
    ends = features.sparkSession.createDataFrame([(0, None, '{"type":"FeatureCollection","features":['), (2, None, "]}")], f"pos int, order {kind}, value string")
    return body.unionByName(ends)


def write_feature_collection(features: DataFrame, path: str, order: str) -> None:
    """Range-sorted text parts whose concatenation in name order is one FeatureCollection."""
    feature_collection(features, order).orderBy("pos", "order", "value").select("value").write.mode("overwrite").text(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL: JSON has neither."""
    fixed = {
        f.name: F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixed) if fixed else df


def summary_json(df: DataFrame) -> DataFrame:
    clean = finite_or_null(df)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_summary(df: DataFrame, path: str) -> None:
    summary_json(df).write.mode("overwrite").text(path)
