"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed n-grams of one to three bytes (lower case,
runs of other characters than letters as one blank), with logarithmic counts and
unit length. Centroids are the clusters that Spark ML's k-means with cosine distance
finds among each language's training vectors. The language of the nearest centroid
wins, ties go to the smaller name. A text farther from it than nearly all training rows
of that language are from their own centroids is ``rejected`` but keeps its nearest
language; one farther than ``max_distance`` is named ``und`` too.

Training takes a bounded sample of labelled documents, in equal parts per language
as far as there are enough; prediction reads whole texts without a shuffle. The
model has a fixed size: languages x centroids x ``DIMENSIONS`` floats.

Defined results: a null text, or one without a letter, is rejected: language ``und``,
score 0. Without training rows every text is. Repeated rows score alike; null ids and
other columns are passed over. Null labels are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from growthlens.llm.common import bounded_sample, remainder, written

DIMENSIONS = 4_096
CENTROIDS = 3  # per language
TRAIN_DOCS = 4_000  # labelled documents in the sample
WITHIN = 0.99  # share of a language's training rows that its distance bound covers
UNKNOWN = "und"

_BYTE = np.zeros(256, np.int64)
_BYTE[128:] = np.arange(128, 256)
_BYTE[97:123] = np.arange(97, 123)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often they occur."""
    b = _BYTE[np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0)
    b = b[(b > 0) | np.r_[True, b[:-1] > 0]]
    total = np.zeros(DIMENSIONS)
    code = b
    for order in range(3):
        if order:
            code = code[:-1] * 257 + b[order:]
        grams = code[code > 0] if order == 0 else code
        total += np.bincount((grams * 2654435761 >> 11) % DIMENSIONS, minlength=DIMENSIONS)
    index = np.flatnonzero(total)
    return index, np.log1p(total[index])


@dataclass
class Centroids:
    names: list[str]
    idf: np.ndarray
    language: np.ndarray  # of each centroid, by position in ``names``
    vectors: np.ndarray  # one unit vector per centroid
    bounds: dict[str, float] = field(default_factory=dict)  # largest distance of a language's own texts

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest centroid's language and its cosine."""
        index, values = ngram_counts(text)
        values = values * self.idf[index]
        length = np.sqrt(values @ values)
        if not len(self.names) or length == 0:
            return UNKNOWN, 0.0
        cosines = np.round(self.vectors[:, index] @ (values / length), 12)
        best = int(np.lexsort((self.language, -cosines))[0])
        return self.names[self.language[best]], float(min(1.0, max(0.0, cosines[best])))


def _training_rows(docs: DataFrame, label: str, at_most: int) -> DataFrame:
    usable = docs.filter(F.col(label).isNotNull() & (F.col(label) != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    usable = usable.filter(remainder("doc_id", 4) != 2).select("doc_id", F.col(label).alias("name"))
    usable = written(usable, "labelled_languages")
    names = [r["name"] for r in usable.select("name").distinct().orderBy("name").collect()]
    if not names:
        return docs.select("text", F.lit("").alias("name")).limit(0)
    parts = [bounded_sample(usable.filter(F.col("name") == n), "doc_id", max(1, at_most // len(names)), "langid") for n in names]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    sample = sample.dropDuplicates(["doc_id"])  # at most at_most short rows
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "name")


def fit(docs: DataFrame, label: str = "lang", at_most: int = TRAIN_DOCS, centroids: int = CENTROIDS) -> Centroids:
    """Learn from ``text`` and ``label`` of at most ``at_most`` documents whose id's checksum leaves no 2 modulo 4."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            index, values = ngram_counts(text)
            row = np.zeros(DIMENSIONS, np.float32)
            row[index] = values
            out.append(row)
        return pd.Series(out, dtype=object)

    rows = _training_rows(docs, label, at_most).select("name", vectors("text").alias("counts"))
    rows = written(rows, "language_vectors").select("name", array_to_vector("counts").alias("counts"))
    if rows.isEmpty():
        return Centroids([], np.ones(DIMENSIONS), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS)))
    idf = IDF(inputCol="counts").fit(rows).idf.toArray() + 1.0  # an n-gram of every text still counts
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="features").transform(weigh.transform(rows)).select("name", "features")
    unit = unit.cache()
    names = [r["name"] for r in unit.select("name").distinct().orderBy("name").collect()]
    language, found = [], []
    for i, name in enumerate(names):
        own = unit.filter(F.col("name") == name)
        means = KMeans(k=max(2, centroids), distanceMeasure="cosine", seed=7, maxIter=8).fit(own).clusterCenters()
        found += means
        language += [i] * len(means)
    matrix = np.array(found)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    owners = np.array(language)

    @F.pandas_udf("double")
    def distance(features: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([1 - max(matrix[owners == names.index(n)] @ x) for x, n in zip(features, name, strict=True)], dtype=float)

    distances = unit.select("name", distance(vector_to_array("features"), "name").alias("d"))
    bounds = {r["name"]: r["bound"] for r in distances.groupBy("name").agg(F.percentile("d", F.lit(WITHIN)).alias("bound")).collect()}
    unit.unpersist()
    return Centroids(names, idf, owners, matrix, bounds)


def _nearest_column(text: Column, model: Centroids) -> Column:
    @F.pandas_udf("lang string, cosine double")
    def nearest(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            yield pd.DataFrame([model.nearest(t) for t in texts], columns=["lang", "cosine"])

    return nearest(text)


def predict(docs: DataFrame, model: Centroids, max_distance: float = 1.0) -> DataFrame:
    """``doc_id, nearest, rejected, lang_pred, score`` per row; ``lang_pred`` is ``und`` without a letter or beyond ``max_distance``."""
    found = docs.select("doc_id", "text", _nearest_column(F.col("text"), model).alias("n"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = found.select("doc_id", "n.lang", "n.cosine", lettered.alias("lettered"))
    far = ~F.col("lettered") | (1 - F.col("cosine") > max_distance)
    bound = F.lit(None).cast("double")
    for name, most in model.bounds.items():
        bound = F.when(F.col("lang") == name, F.lit(most)).otherwise(bound)
    beyond = F.coalesce(1 - F.col("cosine") > bound + 1e-9, F.lit(False))
    return found.select(
        "doc_id",
        F.col("lang").alias("nearest"),
        (far | beyond).alias("rejected"),
        F.when(far, UNKNOWN).otherwise(F.col("lang")).alias("lang_pred"),
        F.when(far, 0.0).otherwise(F.col("cosine")).alias("score"),
    )
