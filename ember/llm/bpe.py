"""BPE encoding through a table of distinct words, and decoding through a join.

1. Tasks split texts into words; counts per word are combined before the shuffle.
2. Every distinct word is encoded once into the word table.
3. Words come back to their positions.  The ``hot`` most frequent words, a fixed
   number, are broadcast; all other words are joined by shuffle.  Each document
   travels as a sequence of word numbers (about 11 bits a word), not as text.
4. Decoding joins the ids of a row to the id-to-piece table.

Character classes are those of the Unicode version of the ``regex`` package;
characters assigned later than the tokenizer's own tables may split otherwise.

Null texts are empty and have no tokens; repeated rows give repeated results;
rows with equal id and text share one dictionary of rare words.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ember.llm.common import stored
from ember.llm.split import slices
from ember.llm.vocabulary import WHITE, Vocabulary, read_vocabulary

#: Fixed value: the word pattern of the tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
#: White-space-free strings whose words a task remembers.
REMEMBERED = 200_000
#: Most frequent words that are broadcast (about 12 MB); the rest is joined.
HOT = 1 << 19
#: Word numbers packed at a time.
BLOCK = 1 << 16


class Splitter:
    """Words of a text: normalised, special strings kept whole."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.special = vocabulary.special_pattern()
        self.specials = vocabulary.specials
        self.find = regex.compile(WORDS).findall
        self.blank = regex.compile(f"[{WHITE}]+")

    def chunks(self, text: str | None) -> list[str]:
        """Runs without white space; ``str.split`` where it means the same."""
        if not text:
            return []
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [c for c in self.blank.split(text) if c]
        return text.split()

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() or ("Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)):
            low = chunk.lower()
            if low.isalpha():  # one word, often with one mark behind it
                return [low]
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return [low[:-1], low[-1]]
        parts = self.special.split(chunk) if "<|" in chunk else [chunk]
        out: list[str] = []
        for part in parts:
            if part in self.specials:
                out.append(part)
            elif part:
                # character by character: no rule depends on neighbours
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.find(low)
        return out


def count_words(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """Distinct words and how often they occur: ``word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunks = Splitter(shared.value), Counter()

        def flush():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for word in split.words(chunk):
                    words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    chunks.update(split.chunks(text))
            if len(chunks) > REMEMBERED:
                yield flush()
        if chunks:
            yield flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(vocabulary: Vocabulary) -> pa.Table:
    """``id, piece`` of the whole vocabulary, a table of fixed size."""
    pieces = sorted(dict(vocabulary.pieces()).items())
    return pa.table({"id": pa.array([i for i, _ in pieces], pa.int32()), "piece": pa.array([p for _, p in pieces], pa.string())})


def _decoded(lists: pa.ListArray, pieces: pa.Table) -> pa.Array:
    """Texts of lists of ids: the distinct ids are joined to the piece table, the pieces by blanks."""
    coded = lists.flatten().dictionary_encode()
    wanted = pa.table({"id": coded.dictionary, "at": pa.array(np.arange(len(coded.dictionary)))})
    texts = wanted.join(pieces, "id").sort_by("at").column("piece").combine_chunks().take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
    texts = texts if known.all() else texts.drop_null()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), " ")
    return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids, an array or packed as in :func:`encode`.

    The id-to-piece table has the fixed size of the vocabulary and is
    broadcast; each batch joins its distinct ids to it once and takes the
    pieces back to their positions.  Pieces are joined by blanks, as a tokenizer
    without a decoder does.  An id that is not in the vocabulary gives no piece;
    null ids give null.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(ids)
                if not pa.types.is_list(lists.type):  # packed: 4 bytes an id
                    sizes = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False) // 4
                    flat = np.frombuffer(b"".join(x for x in lists.to_pylist() if x), "<i4")
                    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = pa.ListArray.from_arrays(bounds, pa.array(flat), mask=lists.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(lists, shared.value)], [*part.schema.names, name])

    schema = StructType([*encoded.schema.fields, StructField(name, StringType())])
    return encoded.mapInArrow(run, schema)


def word_table(words: DataFrame, shared) -> DataFrame:
    """Encode each distinct word once: ``word, n, ids`` (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch in batches:
            ids = [[voc.specials[w]] if w in voc.specials else voc.encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.array(i, "<i4").tobytes() for i in ids], pa.binary())], ["word", "n", "ids"])

    return stored(words.select("word", "n").mapInArrow(run, "word string, n bigint, ids binary"), "words")


def _below(length: np.ndarray) -> np.ndarray:
    """Which of 32 bits, highest first, come after the leading one of a number of ``length`` bits."""
    return np.arange(32) > 32 - length.astype(np.int64)[:, None]


def _pack(codes: np.ndarray) -> bytes:
    """Word numbers as their bit lengths, compressed, and the bits after the leading one.

    Numbers are ranks by frequency, so a number says little beyond its length.
    """
    if len(codes) == 0:
        return b""
    numbers = codes.astype(np.int64) + 1
    length = np.frexp(numbers.astype(np.float64))[1].astype(np.uint8)
    sizes = pa.Codec("brotli", compression_level=4).compress(length.tobytes(), asbytes=True)
    parts = [len(sizes).to_bytes(4, "little"), sizes]
    for a in range(0, len(numbers), BLOCK):
        bits = np.unpackbits(numbers[a : a + BLOCK].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
        parts.append(np.packbits(bits[_below(length[a : a + BLOCK])]).tobytes())
    return b"".join(parts)


def _unpack(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    at = 4 + int.from_bytes(data[:4], "little")
    length = np.frombuffer(pa.decompress(data[4:at], n, codec="brotli", asbytes=True), dtype=np.uint8)
    out = []
    for a in range(0, n, BLOCK):
        part = length[a : a + BLOCK]
        total = int(part.sum(dtype=np.int64)) - len(part)
        size = (total + 7) // 8
        bits = np.zeros((len(part), 32), dtype=np.uint8)
        bits[_below(part)] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=total)
        bits[np.arange(len(part)), 32 - part.astype(np.int64)] = 1
        out.append(np.packbits(bits, axis=1).view(">u4").reshape(-1).astype(np.int64) - 1)
        at += size
    return np.concatenate(out)


class Numbering(dict):
    """White-space-free strings to lists of word numbers.

    Frequent words have their rank, rare ones numbers from ``base`` in the order
    in which this task meets them; ``flat[start[k]:start[k + 1]]`` are those of
    string number ``k``.
    """

    def __init__(self, split: Splitter, rank: dict[str, int]) -> None:
        super().__init__()
        self.split, self.rank, self.base = split, rank, len(rank)
        self.rare: dict[str, int] = {}
        self.flat: list[int] = []
        self.start = [0]

    def __missing__(self, chunk: str) -> int:
        for word in self.split.words(chunk):
            number = self.rank.get(word)
            if number is None:
                number = self.rare.setdefault(word, self.base + len(self.rare))
            self.flat.append(number)
        self.start.append(len(self.flat))
        self[chunk] = got = len(self.start) - 2
        return got


def _gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated slices ``values[begin:begin + length]``."""
    total = int(length.sum())
    if total == 0:
        return values[:0]
    return values[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)]


def encode(docs: DataFrame, path: str, hot: int = HOT, decoded: bool = False) -> DataFrame:
    """Encode whole texts: ``doc_id, n_tokens, ids, packed``; with ``decoded`` also decode the ids.

    Decoding in the task that has just put the ids together is :func:`decode`
    without a second Python worker beside the first.

    ``ids`` is an array, ``packed`` the same ids as little-endian unsigned
    32-bit integers.  A text may hold up to ``2 ** 32 - 1 - hot`` distinct rare words.
    """
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    shared = spark.sparkContext.broadcast(vocabulary)
    pieces = spark.sparkContext.broadcast(piece_table(vocabulary)) if decoded else None
    table = word_table(count_words(docs, shared), shared)
    # ``hot`` bounds what reaches the driver and the workers
    top = table.orderBy(F.desc("n"), "word").limit(hot).toArrow()
    hot_words = spark.sparkContext.broadcast(top.column("word").combine_chunks())  # compact: workers keep it
    lists = [np.frombuffer(i, "<i4") for i in top.column("ids").to_pylist()]
    hot_ids = spark.sparkContext.broadcast((np.cumsum([0, *map(len, lists)]), np.concatenate([np.zeros(0, "<i4"), *lists])))
    lowest = pc.min(top.column("n")).as_py() or 0
    del top, lists

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word numbers of every text, its rare words numbered from ``base`` in order of appearance."""
        split, rank = Splitter(shared.value), {w: i for i, w in enumerate(hot_words.value.to_pylist())}
        known = Numbering(split, rank)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                if len(known) > REMEMBERED:
                    known = Numbering(split, rank)
                strings = []
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    chunks = split.chunks(text)
                    strings.append(np.fromiter(map(known.__getitem__, chunks), np.int32, len(chunks)))
                flat, start, names = np.array(known.flat, dtype=np.int64), np.array(known.start, dtype=np.int64), list(known.rare)
                sizes, packed, rare = [], [], []
                for at in strings:
                    code = _gather(flat, start[at], start[at + 1] - start[at])
                    high = np.flatnonzero(code >= known.base)
                    own: list[str] = []
                    if len(high):
                        found, first, place = np.unique(code[high], return_index=True, return_inverse=True)
                        order = np.argsort(first)
                        rank_of = np.empty(len(order), dtype=np.int64)
                        rank_of[order] = np.arange(len(order))
                        code[high] = known.base + rank_of[place]
                        own = [names[i] for i in (found[order] - known.base).tolist()]
                    sizes.append(len(code))
                    packed.append(_pack(code))
                    rare.append(own)
                words = pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(rare, pa.list_(pa.string()))], ["n", "codes", "rare"])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("doc_id", "k", "k2")], words], ["doc_id", "k", "k2", "words"])

    def listed(batches):
        """The rare words of every text as rows; ``_j`` is the key's second half above the word's place."""
        for batch in batches:
            rare = batch.column("words").field("rare")
            at = pc.list_parent_indices(rare)
            first = np.repeat(rare.offsets.to_numpy()[:-1], np.diff(rare.offsets.to_numpy())) - rare.offsets.to_numpy()[0]
            i = np.arange(len(at)) - first
            j = batch.column("k2").to_numpy().astype(np.int64)[at.to_numpy()] << 32 | i
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), pa.array(j, pa.int64()), rare.flatten()], ["_k", "_j", "word"])

    def assembled(batches):
        offsets, flat = hot_ids.value
        base = len(offsets) - 1
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                words, rare = part.column("words"), part.column("rare").to_pylist()
                own = [np.frombuffer(x, "<i4") for r in rare for x in r or ()]
                values = np.concatenate([flat, *own])
                ends = np.concatenate([offsets, len(flat) + np.cumsum([len(o) for o in own], dtype=np.int64)])
                shift, ids = 0, []
                for n, data, r in zip(words.field("n").to_pylist(), words.field("codes").to_pylist(), rare, strict=True):
                    codes = _unpack(data, n)
                    if r:
                        codes[codes >= base] += shift
                        shift += len(r)
                    ids.append(_gather(values, ends[codes], ends[codes + 1] - ends[codes]))
                sizes = np.array([len(i) for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                more = [_decoded(lists, pieces.value)] if pieces else []
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array([i.tobytes() for i in ids], pa.binary()), *more]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "packed", "decoded"][: len(columns)])

    text = F.col("text").cast("string")
    identity = [F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), text), F.hash(text, F.col("doc_id").cast("string"))]
    source = docs.select("doc_id", identity[0].alias("k"), identity[1].alias("k2"), text.alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    # one exchange, read whole by two consumers: for the rare words and for the documents themselves
    coded = source.mapInArrow(numbered, f"doc_id {kind}, k bigint, k2 int, words struct<n int, codes binary, rare array<string>>").repartition("k", "k2")
    rare = coded.mapInArrow(listed, "_k bigint, _j bigint, word string")
    seldom = table.where(F.col("n") <= lowest).select("word", "ids")
    rare = rare.join(seldom, "word").select("_k", F.shiftright("_j", 32).cast("int").alias("_k2"), F.col("_j").bitwiseAND(F.lit(2**32 - 1)).alias("i"), "ids")
    rare = rare.groupBy("_k", "_k2").agg(F.sort_array(F.collect_set(F.struct("i", "ids"))).alias("rare")).select("_k", "_k2", F.col("rare.ids").alias("rare"))
    both = coded.join(rare, (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")), "left")
    return both.select("doc_id", "k", "k2", "words", "rare").mapInArrow(assembled, f"doc_id {kind}, n_tokens bigint, ids array<int>, packed binary" + ", decoded string" * decoded)
