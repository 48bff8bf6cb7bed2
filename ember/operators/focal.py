"""Neighbourhood statistics with mirrored chip edges."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _sliding(grid: np.ndarray, known: np.ndarray, k: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known values in ``k`` neighbours along ``axis``, edges mirrored.

    The edge pixel itself is repeated (half-sample symmetry): index -1-i shows
    pixel i and size+i shows pixel size-1-i.
    """
    pads = [(k // 2, k // 2) if i == axis else (0, 0) for i in range(3)]
    values, there = np.pad(grid, pads, mode="symmetric"), np.pad(known, pads, mode="symmetric")
    size, total, count = grid.shape[axis], np.zeros(grid.shape), np.zeros(grid.shape, dtype=np.int32)
    for i in range(k):  # in the order of the pixels, so sums do not depend on the batch
        cut = tuple(slice(i, i + size) if a == axis else slice(None) for a in range(3))
        total += values[cut]
        count += there[cut]
    return np.divide(total, count, out=np.zeros_like(total), where=count > 0), count > 0


def _whole_chips(batches: Iterator[pa.RecordBatch], chip: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole chips, with the number of each row's chip, from rows in order of the chip."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        codes = rows.column(chip).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        cut = int(starts[-1]) if len(starts) else 0
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut), codes[:cut]
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, dtype=np.int64)


def focal_means(
    px: DataFrame,
    outputs: Mapping[str, tuple[str, int]],
    height: int,
    width: int,
    chip: str = "chip_id",
) -> DataFrame:
    """Add ``{name: (input column, odd window)}`` mean filters to a pixel table.

    The square mean is separable: means along rows, then along columns of those
    means.  One exchange on the chip; a task reads its chips one after the other
    as Arrow batches and slides over the few input grids of the chips at hand,
    all other columns pass through untouched.  Held are one batch and one chip,
    which the band contract bounds.

    Null inputs and missing pixels do not count, NaN does; a window without a
    value gives null.  Rows of a null chip form one chip.
    """
    for name, (_, k) in outputs.items():
        if k % 2 == 0:
            raise ValueError(f"{name}: window must be odd")
    pad = max(k for _, k in outputs.values()) // 2
    if pad > min(height, width):
        raise ValueError(f"window half-width {pad} exceeds chip extent {min(height, width)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes in _whole_chips(batches, chip):
            rw, cl = (rows.column(c).to_numpy() for c in ("rw", "cl"))
            if len(rw) and not (0 <= rw.min() and rw.max() < height and 0 <= cl.min() and cl.max() < width):
                raise ValueError(f"pixel outside a chip of {height} x {width}")
            shape = (int(codes.max()) + 1, height, width)
            at = (codes.astype(np.int64) * height + rw) * width + cl
            grids = {}
            for source in {c for c, _ in outputs.values()}:
                column = rows.column(source).cast(pa.float64())
                grid, known = np.zeros(shape), np.zeros(shape, dtype=bool)
                grid.flat[at] = pc.fill_null(column, 0.0).to_numpy()
                known.flat[at] = column.is_valid().to_numpy()
                grids[source] = grid, known
            for name, (source, k) in outputs.items():
                mean, known = _sliding(*_sliding(*grids[source], k, 2), k, 1)
                rows = rows.append_column(name, pa.array(mean.reshape(-1)[at], pa.float64(), mask=~known.reshape(-1)[at]))
            yield from rows.combine_chunks().to_batches()

    keyed = px.withColumns({c: F.col(c).cast("bigint") for c in ("rw", "cl")})
    schema = StructType([*keyed.schema.fields, *[StructField(name, DoubleType()) for name in outputs]])
    return keyed.repartition(chip).sortWithinPartitions(chip).mapInArrow(run, schema)


def focal_mean(px: DataFrame, column: str, k: int, height: int, width: int, out: str) -> DataFrame:
    return focal_means(px, {out: (column, k)}, height, width)


def focal_contrast(px: DataFrame, column: str, k: int, height: int, width: int, out: str) -> DataFrame:
    """Value minus its focal mean."""
    mean = focal_means(px, {out: (column, k)}, height, width)
    return mean.withColumn(out, F.col(column) - F.col(out))


def smooth_scores(px: DataFrame, scores: Sequence[str], k: int, height: int, width: int) -> DataFrame:
    """Replace class scores by their focal means, classes independently (float32)."""
    smoothed = focal_means(px, {f"_s_{c}": (c, k) for c in scores}, height, width)
    keep = [c for c in px.columns if c not in scores]
    return smoothed.select(*keep, *[F.col(f"_s_{c}").cast("float").alias(c) for c in scores])
