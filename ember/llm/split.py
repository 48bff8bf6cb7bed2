"""Splitting texts at white space, column-wise in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def split_white(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Strings between Unicode white space, as ``str.split`` gives them.

    Returns how many each text has (0 for null), their numbers in order, and the
    distinct strings by number.
    """
    trimmed = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.utf8_split_whitespace(trimmed)
    sizes = np.diff(lists.offsets.to_numpy())
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if empty.any():
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        sizes = np.where(empty, 0, sizes)
    coded = flat.dictionary_encode()
    return sizes, coded.indices.to_numpy(), coded.dictionary.to_pylist()
