"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade >= k) = sigmoid(score - threshold_k)`` with one weight vector for all
grades and ordered thresholds.  Features are hashed words (present or not) and
hashed shapes of the text (shares of repeated, upper-case, symbol-tailed and
separator words).  The weights give every text an expected grade and the
probability of the top grade.

The fit uses at most ``sample`` labelled rows, chosen by digest, whose sparse
features (not texts) are collected; everything else is a map over all documents.

Null and empty texts have no words and are rejected (tail probability 0).
Labels with a null are ignored; of several labels of one document the worst
grade counts.  Without labels every text with words has tail probability 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = ("repeat", "upper", "tail", "bar", "distinct", "long")
REMEMBERED = 300_000
#: Letters of a word's beginning that are a feature of their own.
PREFIX = 4
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»¡¿…"


class Features:
    """Hashed words and shapes of one text; remembers the strings it has seen."""

    def __init__(self, dims: int) -> None:
        self.dims, self.known = dims, {}

    def look(self, chunk: str) -> tuple[tuple[int, int], bool, bool]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        word = chunk.strip(MARKS).casefold()
        buckets = tuple(zlib.crc32(part.encode("utf-8", "replace")) % self.dims for part in (word, "^" + word[:PREFIX]))
        upper = len(chunk) > 1 and chunk.isupper()
        tail = len(chunk) > 2 and chunk[-1] == chunk[-2] and not chunk[-1].isalnum()
        got = self.known[chunk] = (buckets, upper, tail)
        return got

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        """Distinct word buckets, and one value per shape; no words, no values."""
        chunks = text.split() if text else []
        if not chunks:
            return [], []
        n, distinct = len(chunks), set(chunks)
        known = self.known
        looked = [(c, known.get(c) or self.look(c)) for c in distinct]
        words = sorted({b for _, x in looked for b in x[0]})
        upper, tail = {c for c, x in looked if x[1]}, {c for c, x in looked if x[2]}
        repeats = sum(1 for a, b in zip(chunks, chunks[1:], strict=False) if a == b)
        shares = [
            repeats / n,
            (sum(c in upper for c in chunks) if upper else 0) / n,
            (sum(c in tail for c in chunks) if tail else 0) / n,
            chunks.count("|") / n,
            1 - len(distinct) / n,
        ]
        return words, [*[4 * s for s in shares], min(np.log1p(n), 12) / 4]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top."""
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, grades: int, rounds: int = 300, ridge: float = 1e-4, sparse: float = 3e-4, rate: float = 0.05) -> OrdinalModel:
    """Maximum penalised likelihood by Adam steps over the whole sample.

    ``ridge`` shrinks word weights, ``sparse`` (an absolute penalty) sets those
    of uninformative words to zero, so that long texts gather no noise.
    """
    rows = [r for r in rows if len(r[1])]
    y = np.array([r[2] for r in rows], dtype=np.int64)
    at = np.concatenate([np.asarray(r[0], dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    used = np.flatnonzero(np.bincount(at, minlength=dims))
    place = np.zeros(dims, dtype=np.int32)
    place[used] = np.arange(len(used))
    col = place[at]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    shape = np.array([r[1] for r in rows]).reshape(len(rows), len(SHAPES))
    k = grades - 1
    p = np.zeros(len(used) + len(SHAPES) + k)
    share = np.array([(y < g).mean() for g in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    low = np.log(share / (1 - share))
    p[-k:] = np.concatenate([low[:1], np.log(np.maximum(np.diff(low), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    nw, ns = len(used), len(SHAPES)

    def cuts(raw):
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    for step in range(1, rounds + 1):
        score = np.bincount(row, weights=p[col], minlength=len(rows)) + shape @ p[nw : nw + ns]
        theta = np.concatenate([[-np.inf], cuts(p[-k:]), [np.inf]])
        hi = 1 / (1 + np.exp(-np.clip(theta[y + 1] - score, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(theta[y] - score, -40, 40)))
        lo[y == 0], hi[y == k] = 0.0, 1.0
        width = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / width, lo * (1 - lo) / width
        dscore = (dhi - dlo) / len(rows)
        dtheta = np.array([-(dhi[y == g].sum() - dlo[y == g + 1].sum()) / len(rows) for g in range(k)])
        steps = np.concatenate([[1.0], np.exp(p[-k:][1:])])
        draw = np.cumsum(dtheta[::-1])[::-1] * steps
        grad = np.concatenate([np.bincount(col, weights=dscore[row], minlength=nw), shape.T @ dscore, draw])
        grad[:nw] += ridge * p[:nw]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        # proximal step, in the scale of the Adam step
        shrink = rate * sparse / (np.sqrt(v[:nw] / (1 - 0.999**step)) + 1e-4)
        p[:nw] = np.sign(p[:nw]) * np.maximum(np.abs(p[:nw]) - shrink, 0)
    weights = np.zeros(dims)
    weights[used] = p[:nw]
    return OrdinalModel(weights, p[nw : nw + ns], cuts(p[-k:]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good; null if a rating is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, dims: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Sparse features and grade of at most ``sample`` labelled documents, by digest of the id."""
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).cast("int").alias("grade")).where("grade is not null and doc_id is not null")
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dims)
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), *[pa.array([np.array(g[i], dtype=t).tobytes() for g in got], pa.binary()) for i, t in enumerate(("<i4", "<f8"))]],
                ["doc_id", "grade", "words", "shapes"],
            )

    # the sample is bounded by its parameter, so it may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    found = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, words binary, shapes binary")
    rows = found.toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    read = lambda c, t: [np.frombuffer(v.as_py(), dtype=t) for v in rows.column(c)]
    return list(zip(read("words", "<i4"), read("shapes", "<f8"), rows.column("grade").to_pylist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, dims: int = 1 << 18) -> OrdinalModel | None:
    rows = labelled_sample(docs, labels, sample, dims)
    return fit(rows, dims, 3) if any(len(r[1]) for r in rows) else None


def graded(spark: SparkSession, text: Column, model: OrdinalModel | None, dims: int = 1 << 18) -> Column:
    """Struct ``expected_grade, tail`` of a text; ``tail`` is P(top grade)."""
    shared = spark.sparkContext.broadcast(model and (model.weights, model.shapes, model.thresholds))

    @F.pandas_udf("struct<expected_grade double, tail double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value and OrdinalModel(*shared.value)
        features = Features(dims)
        for texts in batches:
            grade, tail = [], []
            for text in texts:
                words, shapes = features(text)
                if not shapes:
                    probabilities = np.zeros(2)
                elif model is None:
                    probabilities = np.ones(2)
                else:
                    probabilities = model.tails(model.weights[words].sum() + float(np.dot(model.shapes, shapes)))
                grade.append(float(probabilities.sum()))
                tail.append(float(probabilities[-1]))
            yield pd.DataFrame({"expected_grade": grade, "tail": tail})

    return score(text.cast("string"))


def grade_documents(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.5, dims: int = 1 << 18) -> DataFrame:
    """``docs`` with ``expected_grade, tail, keep`` (``tail >= cut``).

    Columns of ``docs`` that have one of these names are replaced.
    """
    added = ("expected_grade", "tail", "keep")
    rows = docs.select(*[docs[c] for c in docs.columns if c not in added], graded(docs.sparkSession, docs["text"], model, dims).alias("__grade"))
    return rows.select("*", F.col("__grade.expected_grade").alias("expected_grade"), F.col("__grade.tail").alias("tail"), (F.col("__grade.tail") >= cut).alias("keep")).drop("__grade")


def select_documents(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.5, dims: int = 1 << 18) -> DataFrame:
    """The rows of ``docs`` whose top-grade probability reaches ``cut``, columns unchanged."""
    return docs.where(graded(docs.sparkSession, docs["text"], model, dims)["tail"] >= cut)
