"""Periodic runs of words: recursive frequency splitting, then a lag scan.

A run is a stretch of words with smallest period ``q`` and a length of at least
``max(6, 4 q)`` that no neighbouring word extends.  Every word of a run occurs
at least four times in it, so a word that occurs less often within the current
segment belongs to no run there and splits the segment.  Splitting is repeated
inside the pieces until nothing is rare any more; prose vanishes within a few
rounds.

The lag scan of what survives takes lags by octaves: for ``2^k <= q < 2^(k+1)``
the block of ``2^(k+1)`` words at a place of a run occurs next exactly ``q``
words later, because a nearer occurrence would give the run a smaller period
(two periods of a stretch as long as their sum leave their greatest common
divisor as period).  Block numbers double from octave to octave, so a segment
of n words takes n log n steps per octave, however many words repeat in it.

The operator is a map over the documents: no shuffle, and memory is bounded by
the longest text and slices of 6 MB.

Nulls, ties and repeats: a null or empty text has no words and no runs and
collapses to the empty text; a null ``doc_id`` and repeated rows are rows like
all others.  Other columns of the input are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ember.llm.common import WORD
from ember.llm.split import slices

#: A run holds its period at least so often, and has at least so many words.
TIMES, SHORTEST = 4, 6

RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _changes(*keys: np.ndarray) -> np.ndarray:
    """First places of the stretches within which no key changes, and the end."""
    n = len(keys[0])
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    for key in keys:
        cut[1:n] |= key[1:] != key[:-1]
    return np.flatnonzero(cut)


def surviving(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places left by the splitting and the number of each one's segment."""
    at, segment = np.arange(len(codes)), docs
    done, numbers, n_done = [], [], 0
    while len(at):
        key = segment * (int(codes.max()) + 1) + codes[at]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        rare = times[which] < TIMES
        starts = _changes(segment)
        sizes = np.diff(starts)
        stable = (np.add.reduceat(rare, starts[:-1]) == 0) & (sizes >= SHORTEST)
        whole = np.repeat(stable, sizes)
        done.append(at[whole])
        numbers.append(n_done + np.repeat(np.arange(stable.sum()), sizes[stable]))
        n_done += int(stable.sum())
        left = ~whole & ~rare
        at, segment = at[left], segment[left]
        if len(at):
            starts = _changes(segment, at - np.arange(len(at)))
            sizes = np.diff(starts)
            segment = np.repeat(np.arange(len(sizes)), sizes)
            long = np.repeat(sizes >= SHORTEST, sizes)
            at, segment = at[long], segment[long]
    return (np.concatenate(done), np.concatenate(numbers)) if done else (np.zeros(0, int), np.zeros(0, int))


def lag_scan(codes: np.ndarray, segment: np.ndarray) -> list[np.ndarray]:
    """Runs inside the segments of a concatenation: arrays of first place, length and period."""
    found = [np.zeros(0, int)] * 3
    if not len(codes):
        return found
    starts = _changes(segment)
    sizes = np.diff(starts)
    size, end = np.repeat(sizes, sizes), np.repeat(starts[1:], sizes)
    _, block = np.unique(segment * (int(codes.max()) + 1) + codes, return_inverse=True)
    half = 1
    while True:
        wide = 2 * half
        # segments too short for this octave take no further part
        at = np.flatnonzero((size >= max(SHORTEST, TIMES * half)) & (np.arange(len(codes)) + wide <= end))
        if not len(at):
            return found
        _, number = np.unique(block[at] * len(codes) + block[at + half], return_inverse=True)
        block = np.full(len(codes), -1)
        block[at] = number
        order = np.argsort(number, kind="stable")
        lag = np.zeros(len(at), int)
        same = number[order[1:]] == number[order[:-1]]
        lag[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
        fits = (lag >= half) & (lag < wide)
        at, lag = at[fits], lag[fits]
        if len(at):
            first = _changes(lag, at - np.arange(len(at)))
            period = lag[first[:-1]]
            length = np.diff(first) + period + wide - 1
            enough = length >= np.maximum(SHORTEST, TIMES * period)
            found = [np.concatenate(x) for x in zip(found, (at[first[:-1]][enough], length[enough], period[enough]))]
        half = wide


def _runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.ascii_trim_whitespace(pc.fill_null(batch.column("text"), ""))
    words = pc.ascii_split_whitespace(texts)
    sizes = np.diff(words.offsets.to_numpy())
    flat = words.flatten()
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text is split into one empty word
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        sizes = np.where(empty, 0, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(len(sizes)), sizes)

    at, segment = surviving(codes, docs) if len(codes) else (codes, codes)
    first, length, period = lag_scan(codes[at], segment)
    start = at[first] if len(first) else first
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]

    depth = np.zeros(len(codes) + 1, int)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.cumsum(depth[:-1]) == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep))), " ")

    mine = docs[start] if len(start) else start
    runs = pa.StructArray.from_arrays([pa.array(start - offsets[mine], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=len(sizes)))])
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column("text")):
            yield _runs_of(batch.slice(start, stop - start))


def find_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text, by start, then period, and the text without their repeats.

    Returns ``doc_id, n_words, runs, collapsed``; a run has its first word's
    number, its length and its period in words.  ``collapsed`` keeps the first
    period of every run, words joined by one space.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_runs, RESULT)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth gets a periodic tail; ``doc_id, text``.

    With h the crc32 of the decimal id and g = floor(h / 10), a text of n words
    with h % 10 = 0 goes on from word a = g % n with words a to a + p - 1 over
    and over, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    words = words.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("bigint"))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("bigint"))

    def word(i: Column) -> Column:
        source = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get("words", source.cast("int"))

    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), word), " ")
    return words.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length per period; the first of equal ones."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.reduce(runs, F.get(runs, 0), lambda best, run: F.when(better(best, run), run).otherwise(best))
