"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ember.session import checkpoint_root, scratch

#: ASCII white space and what lies between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    A columnar cut of the lineage: later stages and recomputed tasks read the
    written table, so a lost executor never repeats what stands before it.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node of an undirected edge table ``u, v``: ``u, root``.

    Alternating large-star and small-star steps.  The smallest neighbour of a
    node is a combined aggregate and comes back by a join that adaptive
    execution splits, so a hub may have any number of edges.  Every round is
    written to the shared folder; only a count and a digest reach the driver.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = mark(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(least, F.col("u") == F.col("_u"))
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))))
        current = stored(small.where("u <> v").distinct(), "edges")
        now = mark(current)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("component search did not settle")
    # every root names itself
    return current.select("u", F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
