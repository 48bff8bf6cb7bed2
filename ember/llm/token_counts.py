"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

Offline it is proven, string by string, which vocabulary strings encode alone
as one token.  A pre-token found among them counts 1 without any merge; only the
rest is merged, each distinct one once per task while it stays in a bounded
memory.  Counting is a map over the documents: no shuffle, any text length.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ember.llm.vocabulary import WHITE, Vocabulary, byte_symbols, read_vocabulary

#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
#: Distinct merged strings that a task remembers; older ones are merged again.
REMEMBERED = 300_000


def whole_tokens(vocabulary: Vocabulary) -> set[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    back = {s: b for b, s in enumerate(byte_symbols())}
    split = regex.compile(PRETOKEN)
    out = set()
    for piece in vocabulary.ids:
        try:
            text = bytes(back[c] for c in piece).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        if split.fullmatch(text) and split.findall(text) == [text] and vocabulary.encode(text) == [vocabulary.ids[piece]]:
            out.add(text)
    return out


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary, whole: set[str]) -> None:
        self.vocabulary, self.whole = vocabulary, whole
        self.special = vocabulary.special_pattern()
        self.special_names = list(vocabulary.specials)
        self.split = regex.compile(PRETOKEN).findall
        # a chunk is a run without white space and at most one blank before it, or white space
        self.chunks = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]").findall
        self.known: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        n = 0
        for piece in self.split(text):
            n += 1 if piece in self.whole else len(self.vocabulary.encode(piece))
        return n

    def plain(self, text: str) -> int:
        known, n = self.known, 0
        if len(known) > REMEMBERED:
            known.clear()
        for chunk in self.chunks(text):
            got = known.get(chunk)
            if got is None:
                got = known[chunk] = self.chunk(chunk)
            n += got
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(name in text for name in self.special_names):
            return sum(1 if part in self.vocabulary.specials else self.plain(part) for part in self.special.split(text) if part)
        return self.plain(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    vocabulary = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    kind = dict(text.dtypes)["doc_id"]
    return text.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
