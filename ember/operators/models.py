"""Per-pixel scorers on ``pyspark.ml`` and the pluggable scorer slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ember.functions.spectral import finite0
from ember.operators.pixels import to_vector


def _ready(px: DataFrame, names: Sequence[str]) -> DataFrame:
    clean = px.withColumns({n: finite0(F.col(n).cast("double")) for n in names})
    return to_vector(clean, names)


def _labelled(px: DataFrame, names: Sequence[str]) -> DataFrame:
    return _ready(px, names).withColumn("label", F.col("y").cast("double"))


def fit_boosted(sample: DataFrame, names: Sequence[str], task: str, rounds: int = 40, depth: int = 5, seed: int = 42, weight: str | None = None, validation: str | None = None):
    """Boosted trees: binary for AF, one-vs-rest for the four burn classes.

    ``validation`` names a boolean column whose rows stop the boosting early.
    """
    booster = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        booster = booster.setWeightCol(weight)
    if validation and task != "af":
        raise ValueError("early stopping is defined for the fire task only: one-vs-rest drops the indicator column")
    if validation:
        booster = booster.setValidationIndicatorCol(validation)
    if task == "af":
        return booster.fit(_labelled(sample, names))
    many = OneVsRest(classifier=booster)
    if weight:
        many = many.setWeightCol(weight)
    return many.fit(_labelled(sample, names))


def fit_forest(sample: DataFrame, names: Sequence[str], trees: int = 60, depth: int = 8, seed: int = 42, weight: str | None = None):
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        forest = forest.setWeightCol(weight)
    return forest.fit(_labelled(sample, names))


def fit_mlp(sample: DataFrame, names: Sequence[str], classes: int, hidden: Sequence[int] = (32, 16), rounds: int = 60, seed: int = 42):
    """Neural scorer on standardised features."""
    net = MultilayerPerceptronClassifier(layers=[len(names), *hidden, classes], maxIter=rounds, seed=seed)
    return net.fit(_labelled(sample, names))


def score(px: DataFrame, model, names: Sequence[str], classes: int, prefix: str = "t") -> DataFrame:
    """Add float32 probabilities ``<prefix>0..`` to every pixel.

    One-vs-rest has margins only: each is squashed and the row normalised.
    """
    ready = _ready(px, names)
    done = model.transform(ready)
    if "probability" in done.columns:
        p = vector_to_array("probability")
        values = [F.get(p, F.lit(c)) for c in range(classes)]
    else:
        margins = vector_to_array("rawPrediction")
        squashed = [1 / (1 + F.exp(-2 * F.get(margins, F.lit(c)))) for c in range(classes)]
        total = squashed[0]
        for s in squashed[1:]:
            total = total + s
        values = [s / total for s in squashed]
    return done.select(*px.columns, *[F.coalesce(v, F.lit(0.0)).cast("float").alias(f"{prefix}{c}") for c, v in enumerate(values)])


def score_with(px: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], names: Sequence[str], classes: int, prefix: str = "n") -> DataFrame:
    """Score pixels with any picklable ``(n, features) -> (n, classes)`` function.

    Runs as an Arrow batch UDF next to the data; batches bound the memory.
    """

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.stack([c.to_numpy(dtype=np.float32) for c in columns], axis=1)
            p = np.asarray(scorer(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)), dtype=np.float32)
            yield pd.Series(list(p))

    scored = px.withColumn("_p", apply(*[F.col(n) for n in names]))
    return scored.select(*px.columns, *[F.get("_p", F.lit(c)).alias(f"{prefix}{c}") for c in range(classes)])


def recipes(raw: DataFrame) -> DataFrame:
    """Recipe rows (``task, selected, threshold, class_multipliers``) with weights.

    ``ensemble_cnn_<w>`` carries the second scorer's weight; ``tree`` and
    ``cnn`` are the pure cases.
    """
    prefix = "ensemble_cnn_"  # fixed value: the name's prefix
    number = F.when(F.col("selected").startswith(prefix), F.substring("selected", len(prefix) + 1, 40))
    share = F.when(~number.rlike("[^0-9.]"), number.try_cast("double"))
    share = F.when(share.between(0, 1), share)
    second: Column = F.when(F.col("selected") == "tree", 0.0).when(F.col("selected") == "cnn", 1.0).otherwise(share)
    backend = F.when(share.isNotNull(), "ensemble").otherwise(F.col("selected"))
    return raw.withColumns({"second_weight": second, "tree_weight": 1 - second, "backend": backend})


def candidate_spec(df: DataFrame, column: str = "spec") -> DataFrame:
    """``NAME=tree|cnn=PATH`` to its parts; malformed rows give NULLs."""
    shape = r"^([^=]+)=(tree|cnn)=(.+)$"
    part = lambda i: F.nullif(F.regexp_extract(column, shape, i), F.lit(""))
    return df.withColumns({"name": part(1), "kind": part(2), "path": part(3)})
