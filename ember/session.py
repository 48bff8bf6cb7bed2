"""Session helpers: settings, checkpointing and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes above which the JVM does not compile a method.
HUGE_METHOD = 8000


def session(app: str = "ember", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build a session with the settings the operators are designed for.

    Adaptive execution sizes shuffles, converts joins to broadcast when the
    measured side is small enough and splits skewed join partitions.  The JVM
    does not compile methods above 8000 bytes of code, so a stage that would
    generate a larger one falls back to expressions split into small methods.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    A local folder is made up only on a local master; on a cluster the setting
    must name storage that every executor can reach.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="ember-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


@contextmanager
def compilable(spark: SparkSession) -> Iterator[None]:
    """Within it, stages whose generated method the JVM would interpret are split, as in :func:`session`."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit, None)
    if before is not None and int(before) <= HUGE_METHOD:
        yield
        return
    spark.conf.set(limit, str(HUGE_METHOD))
    try:
        yield
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its plan."""
    checkpoint_root(df.sparkSession)
    with compilable(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """Return a fresh sub-folder path of the shared folder (not yet created)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
