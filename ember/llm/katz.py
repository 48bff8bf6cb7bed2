"""Katz backoff language model: Good-Turing discounted bigrams with exact backoff weights.

    P(w | h) = d(c(h w)) c(h w) / (c(h) + ESCAPE)   if the pair occurs in training
             = alpha(h) P(w)                         otherwise
    P(w)     = d(c(w)) c(w) / N,  and the rest of the mass for unknown words
               (N + ESCAPE instead of N if no word is discounted, so that some is left)

``d`` are Good-Turing discount factors for counts up to ``CUT`` (1 above), and
``alpha(h)`` is computed from the sums over all followers of ``h``, so that the
probabilities of the vocabulary and the unknown word add up to 1 exactly.
``ESCAPE`` keeps a sliver of mass in contexts without discounted followers.

Tables.  ``unigrams`` (word, counts) and ``contexts`` (c(h), alpha(h)) are stored
tables.  Pair counts live in buckets of positions: pairs are dealt by their
context, those of frequent contexts by the pair; every bucket counts its pairs
and evaluates its positions in one pass.  Positions between two of the ``TOP``
most frequent words are counted densely (``TOP ** 2`` cells, a fixed bound) and
need no common bucket: they are evaluated where the text is read, and only their
sums per text travel.  Nor do other frequent pairs: ``KEPT`` counters per task
find all that stand at more than ``max(bucket / 4, 4 n / KEPT)`` of the ``n``
positions, and their counts, at most ``KEPT / 2``, are broadcast.  Counts of the
``HOT`` most frequent words are broadcast, those of other words are joined to the
buckets in which they occur.

Words are runs between ASCII white space with A-Z lower-cased; every text ends
with one end token.  Null texts are empty; repeated rows count and score alike;
a row without ``doc_id`` is treated as having the id "".
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.llm.bagminhash import mix
from ember.llm.common import stored
from ember.llm.split import slices

CUT, ESCAPE = 5, 0.01
TOP, SPREAD, HOT = 512, 8192, 1 << 18
BUCKET = 600_000
REMEMBERED = 120_000
KEPT = 1 << 17  # pair counters of a task
SLICE, DEALT = 600_000, 1_800_000  # bytes of text counted and dealt at once
PORTION = 400_000  # positions taken into the pair counters at once
BOS, END = 0, 1  # first two numbers of frequent words
RARE = np.uint64(1) << np.uint64(63)
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Bytes between ASCII white space; ``bytes.lower`` changes A-Z only."""
    return (text or "").encode("utf-8").lower().split()


def discounts(seen: list[int]) -> np.ndarray:
    """Discount factors of counts 1..CUT from ``seen[r]``, the number of types seen r + 1 times.

    Katz's formula; where the counts of counts do not give factors in (0, 1),
    absolute discounting takes its place.
    """
    n = [0, *seen]
    if all(n[1 : CUT + 2]):
        tail = (CUT + 1) * n[CUT + 1] / n[1]
        r = np.arange(1, CUT + 1)
        star = np.array([(i + 1) * n[i + 1] / n[i] for i in r])
        d = (star / r - tail) / (1 - tail) if tail < 1 else np.zeros(CUT)
        if ((d > 0) & (d < 1)).all():
            return d
    amount = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return 1 - amount / np.arange(1, CUT + 1)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``d(c) c`` of an array of counts."""
    factor = np.concatenate([[0.0], d, [1.0]])
    return factor[np.minimum(count, CUT + 1).astype(np.int64)] * count


class Known(dict):
    """Word to number: rank of a frequent word, else its hash with the top bit set."""

    def __init__(self, names: list[bytes]) -> None:
        super().__init__(zip(names, range(2, len(names) + 2), strict=True))
        self.names = names

    def __missing__(self, word: bytes) -> int:
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | (1 << 63)
        return got

    def trimmed(self) -> Known:
        return Known(self.names) if len(self) > len(self.names) + REMEMBERED else self


def _row(split: list[bytes], known: Known) -> np.ndarray:
    """Numbers of a text's words between its start and its end."""
    row = np.empty(len(split) + 2, dtype=U)
    row[0], row[-1] = BOS, END
    row[1:-1] = np.fromiter(map(known.__getitem__, split), U, len(split))
    return row


def positions(texts: list[str | None], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, context, word)`` of every token of a batch."""
    return _between([_row(words_of(text), known) for text in texts])


def _between(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) - 1 for r in rows], dtype=np.int64)
    flat = np.concatenate(rows)
    word = np.ones(len(flat), bool)
    word[np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])] = False
    at = np.flatnonzero(word)
    return np.repeat(np.arange(len(rows)), sizes), flat[at - 1], flat[at]


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * U(0x9E3779B97F4A7C15) + mix(w))


class Heavy:
    """Counters of frequent pairs (Misra-Gries): each falls short of the true count by at most ``2 n / kept``.

    Of a portion of m positions only pairs above ``m / kept`` reach the counters.
    """

    def __init__(self, kept: int = KEPT) -> None:
        self.kept, self.n = kept, 0
        self.h, self.w, self.count = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, w: np.ndarray) -> None:
        if not len(h):
            return
        self.n += len(h)
        pair = _pair(h, w)
        order = np.argsort(pair)
        starts = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1], [True]]))
        count = np.diff(starts)
        some = count > len(h) // self.kept
        one = order[starts[:-1][some]]
        h, w = np.concatenate([self.h, h[one]]), np.concatenate([self.w, w[one]])
        count = np.concatenate([self.count, count[some]])
        _, first, at = np.unique(_pair(h, w), return_index=True, return_inverse=True)
        count = np.bincount(at, weights=count, minlength=len(first)).astype(np.int64)
        if len(count) > self.kept:
            place = len(count) - self.kept - 1
            count -= np.partition(count, place)[place]
        left = count > 0
        self.h, self.w, self.count = h[first[left]], w[first[left]], count[left]

    def batch(self) -> pa.RecordBatch:
        """Counters above ``n / kept``; leaving out the others costs as much again."""
        some = self.count > self.n / self.kept
        return pa.RecordBatch.from_arrays([pa.array(self.h[some].view(np.int64)), pa.array(self.w[some].view(np.int64)), pa.array(self.count[some])], ["h", "w", "every"])


def _pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Frequent numbers as three compressed byte planes, hashes of rare words apart."""
    rare = ids >= RARE
    codes = np.where(rare, U(0xFFFFFF), ids).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return pa.compress(np.ascontiguousarray(codes).tobytes(), codec="zstd", asbytes=True), ids[rare].tobytes()


def _squeeze(small: np.ndarray) -> bytes:
    """Whole numbers below 2^32, one byte each but for those of 255 and more."""
    big = small >= 255
    return len(small).to_bytes(4, "little") + np.where(big, 255, small).astype(np.uint8).tobytes() + small[big].astype("<u4").tobytes()


def _stretch(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", offset=4 + n)
    return out


def _unpack(data: bytes, rare: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 3 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, n).astype(U)
    ids = planes[0] | planes[1] << U(8) | planes[2] << U(16)
    ids[ids == U(0xFFFFFF)] = np.frombuffer(rare, U)
    return ids


def _sample_words(docs: DataFrame, rows: int = 2000) -> list[bytes]:
    """Frequent words of a bounded sample; they decide the layout, never a result."""
    words = docs.select("text").limit(rows).select(F.explode(F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")).alias("w"))
    top = words.where("w <> ''").groupBy("w").count().orderBy(F.desc("count"), "w").limit(TOP - 2).collect()
    return [r["w"].encode("utf-8") for r in top]


def _counted(source: DataFrame, top: list[bytes]) -> tuple[DataFrame, DataFrame]:
    """``word, pair, train, every``: word counts, and counts of pairs of top words as cells; ``h, w, every``: counters of other frequent pairs."""
    shared = source.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inside, heavy = Known(shared.value), U(len(shared.value) + 2), Heavy()
        train, other, cells, waiting = Counter(), Counter(), np.zeros(TOP * TOP, np.int64), []
        names = ["word", "pair", "h", "w", "train", "every"]

        def flush():
            words = list(train.keys() | other.keys())
            at = np.flatnonzero(cells)
            none = pa.nulls(len(words) + len(at), pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.array(words + [None] * len(at), pa.binary()), pa.array([None] * len(words) + at.tolist(), pa.int32()), none, none, pa.array([train[w] for w in words] + cells[at].tolist(), pa.int64()), pa.array([train[w] + other[w] for w in words] + cells[at].tolist(), pa.int64())],
                names,
            )
            train.clear(), other.clear()
            cells[:] = 0
            return out

        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                known, rows = known.trimmed(), []
                learns = batch.column("train").slice(a, b - a).to_pylist()
                for text, learn in zip(batch.column("text").slice(a, b - a).to_pylist(), learns, strict=True):
                    split = words_of(text)
                    (train if learn else other).update(split)
                    rows.append(_row(split, known))
                owner, h, w = _between(rows)
                both = (h < inside) & (w < inside)
                waiting.append((h[~both], w[~both]))
                if sum(len(x) for x, _ in waiting) > PORTION:
                    heavy.add(*map(np.concatenate, zip(*waiting)))
                    waiting = []
                both &= np.array(learns, bool)[owner]
                cells += np.bincount((h[both] * U(TOP) + w[both]).astype(np.int64), minlength=TOP * TOP)
                if len(train) + len(other) > 2 * REMEMBERED:
                    yield flush()
        yield flush()
        if waiting:
            heavy.add(*map(np.concatenate, zip(*waiting)))
        h, w, every = heavy.batch().columns
        yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.int32()), h, w, pa.array(np.zeros(len(h), np.int64)), every], names)

    counted = source.mapInArrow(run, "word binary, pair int, h bigint, w bigint, train bigint, every bigint")
    counted = stored(counted.groupBy("word", "pair", "h", "w").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "unigrams")
    return counted.where("h is null").drop("h", "w"), counted.where("h is not null").select("h", "w", "every")


def hot_pairs(source: DataFrame, counters: DataFrame, words, names: list[bytes], every: int, bucket_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs of frequent words outside the cells: sorted pair hashes, contexts, words and training counts.

    Every pair that stands at ``max(bucket_size / 4, 4 every / KEPT)`` positions is among them.
    """
    least = max(bucket_size // 4, -(-4 * every // KEPT)) - 3 * every / KEPT
    found = counters.where(F.col("every") >= float(least)).toArrow()
    h, w = (found.column(c).to_numpy().view(U) for c in ("h", "w"))
    if len(h):
        number = {int.from_bytes(hashlib.blake2b(n, digest_size=8).digest(), "little") | (1 << 63): i + 2 for i, n in enumerate(names)}
        h, w = (np.array([number.get(i, i) for i in c.tolist()], dtype=U) for c in (h, w))
        both = (h < RARE) & (w < RARE)
        h, w = h[both], w[both]
    pair, at = np.unique(_pair(h, w), return_index=True)
    h, w, total = h[at], w[at], np.zeros(len(pair), np.int64)
    if not len(pair):
        return pair, h, w, total
    shared = source.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = Known(words.value), shared.value
        count = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                known = known.trimmed()
                _, h, w = positions(batch.column("text").slice(a, b - a).to_pylist(), known)
                one = _pair(h, w)
                place = np.minimum(np.searchsorted(pairs, one), len(pairs) - 1)
                count += np.bincount(place[pairs[place] == one], minlength=len(pairs))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["at", "train"])

    counted = source.where("train").select("text").mapInArrow(run, "at int, train bigint").groupBy("at").agg(F.sum("train").alias("train")).toArrow()
    total[counted.column("at").to_numpy()] = counted.column("train").to_numpy()
    return pair, h, w, total


def score_texts(docs: DataFrame, hot: int = HOT, bucket_size: int = BUCKET) -> DataFrame:
    """Learn from the documents outside the held-out tenth and score all of them.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``.  A document is held out if crc32 of its id's text is 0 modulo 10.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    text = F.col("text").cast("string")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(identity, F.coalesce(text, F.lit(""))).alias("k"), (F.crc32(identity.cast("binary")) % 10 != 0).alias("train"), text.alias("text"))
    top = _sample_words(docs)
    inside = U(len(top) + 2)  # a sample of few words leaves numbers below TOP to words whose pairs are not in the cells
    counts, counters = _counted(source, top)
    words = counts.where("word is not null").select("word", "train", "every")
    totals = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("train").cast("bigint")), F.lit(0))).first()
    n_docs, n_train = int(totals[0]), int(totals[1])
    row = words.agg(F.sum("train"), F.sum("every"), F.sum((F.col("train") > 0).cast("bigint")), *[F.sum((F.col("train") == r).cast("bigint")) for r in range(1, CUT + 2)]).first()
    n, every, types = int(row[0] or 0) + n_train, int(row[1] or 0) + n_docs, int(row[2] or 0) + (n_train > 0)
    seen = [int(row[2 + r] or 0) + (n_train == r) for r in range(1, CUT + 2)]
    d1 = discounts(seen)
    held = sum(r * seen[r - 1] * (1 - d1[r - 1]) for r in range(1, CUT + 1))
    # without discounted words the unknown word has a sliver, as contexts have
    reserve = ESCAPE if held <= 0 else 0.0
    mass_of_words = n + reserve
    unknown = (held + reserve) / mass_of_words
    base_floor = n + 0.1 * (types + 1)

    # frequent words: the sampled top first, then by count; a fixed number, kept in columns
    ranked = words.where(~F.col("word").isin([bytearray(w) for w in top])) if top else words
    ranked = ranked.orderBy(F.desc("every"), "word").limit(hot).select("word", "train").toArrow()
    first = {bytes(r["word"]): r["train"] for r in words.where(F.col("word").isin([bytearray(w) for w in top])).collect()} if top else {}
    names = [*top, *ranked.column("word").to_pylist()]
    hot_count = np.concatenate([[0, n_train], [first.get(w, 0) for w in top], ranked.column("train").to_numpy()]).astype(np.int64)
    del ranked
    as_context = hot_count.copy()
    as_context[BOS], as_context[END] = n_train, 0
    dense = counts.where("pair is not null").select("pair", "train").toArrow()
    cells = np.zeros((TOP, TOP), dtype=np.int64)
    cells.flat[dense.column("pair").to_numpy()] = dense.column("train").to_numpy()
    listed = context.broadcast(names)
    pairs, pairs_h, pairs_w, pair_counts = hot_pairs(source, counters, listed, names, every, bucket_size)
    shared = context.broadcast((hot_count, as_context, cells, inside, pairs, pair_counts))
    del names, dense
    buckets = max(1, -(-every // bucket_size))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, part, number = Known(listed.value), shared.value[4], TaskContext.get().partitionId(), 0
        hot_count, as_context, *counted = shared.value
        names = ["bucket", "rows", "n", "base", "keys", "runs", "train", "h", "hr", "w", "wr"]
        for batch in batches:
            for a, b in slices(batch.column("text"), DEALT):
                known = known.trimmed()
                owner, h, w = positions(batch.column("text").slice(a, b - a).to_pylist(), known)
                keys = batch.column("k").slice(a, b - a).to_numpy(zero_copy_only=False)
                learn = batch.column("train").slice(a, b - a).to_numpy(zero_copy_only=False)
                base = part << 40 | number << 20
                dense = (h < inside) & (w < inside)
                if len(pairs):
                    one = _pair(h, w)
                    dense |= pairs[np.minimum(np.searchsorted(pairs, one), len(pairs) - 1)] == one
                with np.errstate(over="ignore"):
                    place = (mix(np.where(h < SPREAD, h * U(0x9E3779B97F4A7C15) + mix(w), h)) % U(buckets)).astype(np.int64)
                # dense positions are evaluated here; their result rows may go anywhere
                place = np.where(dense, buckets + (part * 7919 + number) % buckets, place)
                names_of_texts = _rows([3], [{"k": base + np.arange(len(keys)), "c": keys}])
                number += 1
                order = np.argsort(place, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1], [True]]))
                columns: dict[str, list] = {c: [v] for c, v in zip(names, [(part * 7919 + number) % buckets, _packed_rows(names_of_texts), 0, 0, b"", b"", b"", b"", b"", b"", []], strict=True)}
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    at = order[x:y]
                    own = owner[at]
                    bucket = int(place[at[0]])
                    if bucket >= buckets:
                        done = _evaluate(h[at], w[at], base + own, learn[own], None, None, hot_count, as_context, counted, d1, mass_of_words, unknown, base_floor)
                        for c, v in zip(names, [bucket - buckets, _packed_rows(done), 0, 0, b"", b"", b"", b"", b"", b"", []], strict=True):
                            columns[c].append(v)
                        continue
                    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    hd, hr = _pack(h[at])
                    wd, _ = _pack(w[at])
                    wr = w[at][w[at] >= RARE].view(np.int64).tolist()
                    values = [bucket, None, len(at), base, _squeeze(np.diff(own[starts], prepend=0)), _squeeze(np.diff(np.append(starts, len(own)))), learn[own[starts]].astype(np.uint8).tobytes(), hd, hr, wd, wr]
                    for c, v in zip(names, values, strict=True):
                        columns[c].append(v)
                kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
                packed = [pa.array(columns[c], t) for c, t in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([packed[0], pa.StructArray.from_arrays(packed[1:], names[1:])], ["bucket", "seg"])

    seg = "struct<rows binary, n int, base bigint, keys binary, runs binary, train binary, h binary, hr binary, w binary, wr array<bigint>>"
    parts = source.select("k", "train", "text").mapInArrow(dealt, f"bucket int, seg {seg}").repartition("bucket")
    # counts of rare words for the buckets in which they stand; whole rows are read, so that the exchange is shared
    own = parts.mapInArrow(_rare_words, "_bucket int, id bigint").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = set(listed.value)
        for batch in batches:
            rows = [(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") | (1 << 63), c) for w, c in zip(batch.column("word").to_pylist(), batch.column("train").to_pylist(), strict=True) if w not in rank]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([r[0] for r in rows], dtype=U).view(np.int64)), pa.array([r[1] for r in rows], pa.int64())], ["word_id", "count"])

    rare = words.mapInArrow(hashed, "word_id bigint, count bigint")
    own = own.join(rare, F.col("id") == F.col("word_id")).select("_bucket", "id", "count")
    names = ["kind", "k", "h", "x", "base", "tokens", "known", "c", *[f"n{r}" for r in range(1, CUT + 2)]]

    def evaluated(left: pa.Table, right: pa.Table) -> pa.Table:
        hot_count, as_context, *_ = shared.value
        segments = [s.as_py() for s in left.column("seg")]
        out = [_unpacked_rows(s["rows"]) for s in segments if s["rows"] is not None]
        rows = [s for s in segments if s["rows"] is None]
        if rows:
            ids, count = right.column("id").to_numpy().view(U), right.column("count").to_numpy()
            order = np.argsort(ids)
            out.append(_evaluate(*_positions_of(rows), ids[order], count[order], hot_count, as_context, None, d1, mass_of_words, unknown, base_floor))
        return pa.concat_tables(out) if out else _rows([], [])

    schema = "kind tinyint, k bigint, h bigint, x double, base double, tokens int, known int, c bigint, " + ", ".join(f"n{r} int" for r in range(1, CUT + 2))
    found = parts.groupBy("bucket").cogroup(own.groupBy("_bucket")).applyInArrow(evaluated, schema)
    # rows of one text or context from several buckets are combined before the shuffle
    found = stored(found.groupBy("kind", "k", "h").agg(*[F.sum(m).alias(m) for m in names[3:]]), "katz")
    for sent in (listed, shared):  # else reused workers keep them
        sent.unpersist()

    # contexts: sums over all followers; those of frequent pairs are known here
    dense_rows = _dense_contexts(cells, hot_count, d1, mass_of_words) + _pair_contexts(pairs_h, pairs_w, pair_counts, hot_count, d1, mass_of_words)
    contexts = found.where("kind = 1").select("h", "x", "c", *names[8:]).unionByName(spark.createDataFrame(dense_rows, "h bigint, x double, c bigint, " + ", ".join(f"{m} bigint" for m in names[8:])))
    contexts = contexts.groupBy("h").agg(F.sum("x").alias("mass"), F.sum("c").alias("c"), *[F.sum(m).alias(m) for m in names[8:]])
    contexts = stored(contexts, "contexts")
    totals = contexts.agg(*[F.coalesce(F.sum(m), F.lit(0)) for m in names[8:]]).first()
    d2 = discounts([int(t) for t in totals])
    kept = F.col("c") - sum((F.col(f"n{r}") * float(r * (1 - d2[r - 1])) for r in range(1, CUT + 1)), F.lit(0.0))
    contexts = contexts.select(F.col("h").alias("_h"), F.log10((1 - kept / (F.col("c") + ESCAPE)) / F.greatest(1 - F.col("mass"), F.lit(unknown))).alias("alpha"))
    # followers never hold the unknown word's share, so the divisor is exact but for rounding
    backed = found.where("kind = 2").select("k", "h", "n1").join(contexts, F.col("h") == F.col("_h"), "left")
    backed = backed.select("k", (F.col("n1") * F.coalesce("alpha", F.lit(0.0))).alias("x"))
    factor = sum((F.col(f"n{r}") * float(np.log10(d2[r - 1])) for r in range(1, CUT + 1)), F.lit(0.0))
    plain = found.where("kind = 0").select("k", (F.col("x").cast("double") + factor).alias("x"), F.col("base").cast("double").alias("base"), "tokens", "known")
    sums = plain.unionByName(backed.select("k", "x", F.lit(0.0).alias("base"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("known"))).groupBy(F.col("k").alias("_k"))
    sums = sums.agg(F.sum("x").alias("_x"), F.sum("base").alias("_base"), F.sum("tokens").alias("_tokens"), F.sum("known").alias("_known"))
    named = found.where("kind = 3").select(F.col("k").alias("_number"), F.col("c").alias("_text"))
    sums = sums.join(named, F.col("_k") == F.col("_number")).groupBy(F.col("_text").alias("_k"))
    sums = sums.agg(*[F.sum(c).alias(c) for c in ("_x", "_base", "_tokens", "_known")])
    rows = source.select("doc_id", "k", "train")
    same = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")).select(F.col("k").alias("_k"), "_rows")
    sums = sums.join(same, "_k")
    out = rows.join(sums, F.col("k") == F.col("_k"))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), (F.col("_tokens") / F.col("_rows")).cast("bigint").alias("n_tokens"), (F.col("_known") / F.col("_rows")).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("_base") / F.col("_rows")).alias("base_score"), (F.col("_x") / F.col("_rows")).alias("score"),
    )


def _rows(kinds: list[int], columns: list[dict]) -> pa.Table:
    """Result rows of the given kinds; columns left out are 0."""
    kind = {"kind": pa.int8(), "k": pa.int64(), "h": pa.int64(), "x": pa.float64(), "base": pa.float64(), "tokens": pa.int32(), "known": pa.int32(), "c": pa.int64()} | {f"n{r}": pa.int32() for r in range(1, CUT + 2)}
    tables = []
    for number, given in zip(kinds, columns, strict=True):
        size = len(next(iter(given.values())))
        tables.append(pa.table({c: pa.array(given[c], t) if c in given else pa.array(np.full(size, number if c == "kind" else 0), t) for c, t in kind.items()}))
    return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], t) for c, t in kind.items()})


def _probability(count: np.ndarray, d1: np.ndarray, n: float, unknown: float) -> np.ndarray:
    return np.where(count > 0, discounted(count, d1) / n, unknown)


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, seg in zip(batch.column("bucket").to_pylist(), batch.column("seg")):
            ids = np.unique(np.array(seg["wr"].as_py(), dtype=np.int64))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket, np.int32)), pa.array(ids)], ["_bucket", "id"])


def _packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _positions_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, word, text and training mark of the positions of a bucket."""
    h = np.concatenate([_unpack(r["h"], r["hr"], r["n"]) for r in rows])
    w = np.concatenate([_unpack(r["w"], np.array(r["wr"], dtype=np.int64).tobytes(), r["n"]) for r in rows])
    runs = np.concatenate([_stretch(r["runs"]) for r in rows])
    key = np.repeat(np.concatenate([r["base"] + np.cumsum(_stretch(r["keys"])) for r in rows]), runs)
    return h, w, key, np.repeat(np.concatenate([np.frombuffer(r["train"], np.uint8) for r in rows]), runs)


def _evaluate(h, w, key, learn, ids, count, hot_count, as_context, counted, d1, n, unknown, base_floor) -> pa.Table:
    """Count the pairs of one bucket, unless they are ``counted``, and evaluate its positions."""
    last = U(len(hot_count) - 1)
    word_count = hot_count[np.minimum(w, last).astype(np.int64)]
    rare = np.flatnonzero(w >= RARE)
    if len(rare):
        word_count[rare] = count[np.searchsorted(ids, w[rare])]
    contexts = None
    if counted is not None:
        cells, inside, pairs, counts = counted
        both = (h < inside) & (w < inside)
        pair_count = np.empty(len(h), np.int64)
        pair_count[both] = cells[h[both].astype(np.int64), w[both].astype(np.int64)]
        pair_count[~both] = counts[np.searchsorted(pairs, _pair(h[~both], w[~both]))]
        context_count = as_context[h.astype(np.int64)]
    else:
        pair = _pair(h, w)
        order = np.argsort(pair)
        starts = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
        total = np.add.reduceat(learn[order].astype(np.int64), starts)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        pair_count = total[place]
        one = order[starts][total > 0]  # one position of every pair of the training texts
        names, inverse = np.unique(h, return_inverse=True)
        context_count = np.bincount(inverse, weights=learn, minlength=len(names)).astype(np.int64)[inverse]
        known = h <= last  # their pairs are dealt over buckets or counted apart, but their counts are known
        context_count[known] = as_context[h[known].astype(np.int64)]
        group, c = inverse[one], pair_count[one]
        sums = {"h": names.view(np.int64), "x": np.bincount(group, weights=_probability(word_count[one], d1, n, unknown), minlength=len(names)), "c": np.bincount(group, weights=c, minlength=len(names)).astype(np.int64)}
        sums |= {f"n{r}": np.bincount(group[c == r], minlength=len(names)) for r in range(1, CUT + 2)}
        some = np.flatnonzero(sums["c"])
        contexts = {m: v[some] for m, v in sums.items()}
    seen = pair_count > 0
    x = np.where(seen, np.log10(np.maximum(pair_count, 1)) - np.log10(np.maximum(context_count, 1) + ESCAPE), np.log10(_probability(word_count, d1, n, unknown)))
    base = np.log10((word_count + 0.1) / base_floor)
    texts, at = np.unique(key, return_inverse=True)
    add = lambda weights: np.bincount(at, weights=weights, minlength=len(texts))
    docs = {"k": texts, "x": add(x), "base": add(base), "tokens": add(None), "known": add(word_count > 0)}
    docs |= {f"n{r}": np.bincount(at[pair_count == r], minlength=len(texts)) for r in range(1, CUT + 1)}
    kinds, columns = [0], [docs]
    if contexts is not None:
        kinds, columns = [0, 1], [docs, contexts]
    backed = np.flatnonzero(~seen)
    if len(backed):
        order = backed[np.lexsort((h[backed], key[backed]))]
        starts = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])]))
        kinds.append(2)
        columns.append({"k": key[order][starts], "h": h[order][starts].view(np.int64), "n1": np.diff(np.append(starts, len(order)))})
    return _rows(kinds, columns)


def _dense_contexts(cells: np.ndarray, hot_count: np.ndarray, d1: np.ndarray, n: float) -> list[tuple]:
    """Context sums of pairs of top words."""
    counts = np.zeros(TOP, dtype=np.int64)
    counts[: min(TOP, len(hot_count))] = hot_count[:TOP]
    p = discounted(counts, d1) / n
    out = []
    for h in np.flatnonzero(cells.sum(axis=1)):
        row = cells[h]
        out.append((int(h), float(p[row > 0].sum()), int(row.sum()), *[int((row == r).sum()) for r in range(1, CUT + 2)]))
    return out


def _pair_contexts(h: np.ndarray, w: np.ndarray, count: np.ndarray, hot_count: np.ndarray, d1: np.ndarray, n: float) -> list[tuple]:
    """Context sums of frequent pairs outside the cells."""
    some = count > 0
    h, w, count = h[some], w[some].astype(np.int64), count[some]
    names, at = np.unique(h, return_inverse=True)
    add = lambda weights: np.bincount(at, weights=weights, minlength=len(names))
    sums = [add(discounted(hot_count[w], d1) / n).tolist(), *[add(c).astype(np.int64).tolist() for c in (count, *[count == r for r in range(1, CUT + 2)])]]
    return list(zip(names.astype(np.int64).tolist(), *sums, strict=True))
