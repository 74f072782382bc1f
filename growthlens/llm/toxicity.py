"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. Two words are compared by the subsequences of three characters that they
share, each weighted by ``DECAY`` to the power of the length it spans, gaps
included; spans are at most ``SPAN`` long and words begin and end with a marker.
So an insult with inserted characters or gaps, or with another ending, stays near
the insult. Values are scaled by a function of the two lengths. A sentence compares
by its words: its margin is the largest of theirs, as one insult makes it toxic. A document is described by its largest margins (``SUMMARY``),
since words that only resemble an insult occur once by chance and insults return.

Training. A bounded sample of labelled documents is cut into distinct sentences,
each labelled by its document, clean where a clean document holds it as well. Words
that sentences of toxic documents hold far more often than chance explains, counted by
the surroundings they occur in, are the positive examples, words of clean sentences the negative ones, and clean words that a first
machine finds suspicious join for the second. Landmarks are spread over both kinds;
the words' kernel values against them, times the inverse root of the landmarks' own
kernel matrix, are the features of a linear SVM fitted by Spark ML. A logistic
regression on the summaries of the training documents gives probabilities.

Scoring. The machine is linear in the kernel, so its landmarks fold into one weight
per subsequence (262,144 floats, fixed). Texts are read whole; there is no shuffle.

Defined results: a null, empty or wordless text has the margin of a word that shares
nothing with any landmark. Without labels, or with labels of one kind, every score is
the share of toxic labels (0 without labels). Repeated rows score alike; null ids and
other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from growthlens.llm.common import bounded_sample, remainder, written

DECAY = 0.8
SPAN = 7
SYMBOLS = 64
LONGEST = 26  # characters of a word that are compared at once; longer words are read in overlapping windows
TRAIN_DOCS = 3_000  # labelled documents of each kind that the sample may hold
WORDS = 4_000  # training words of each kind
LANDMARKS = 128  # of each kind
SURPRISE = 6.0  # standard deviations above its expectation that a word's count in toxic sentences has to be
ORDINARY = 3.0  # below as many a word is ordinary
SPREAD = 1_500  # most surprising words among which the landmarks are spread
MEMO_WORDS = 100_000  # in each of the two generations that a worker remembers
SLICE_CHARS = 1_000_000  # text that a task splits into words at once
SUMMARY = ("first", "top3", "top8", "log_positive", "share")  # of the margins of a document's distinct words
_EDGES = ".,;:!?\"'()[]{}<>|*&%$#@~`^_=+/\\-…"
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def units(text: str) -> list[str]:
    """The words of a lower-cased text. A word with other characters between its letters also counts
    without them, and three or more single characters in a row also form one word."""
    out, run = [], []
    for word in text.split():
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            out += ["".join(run)] if len(run) > 2 else run
            run = []
        word = word.strip(_EDGES) or word
        out.append(word)
        if not word.isalpha():
            letters = "".join(filter(str.isalpha, word))
            if len(letters) > 2:
                out.append(letters)
    if run:
        out += ["".join(run)] if len(run) > 2 else run
    return out


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def symbols(words: list[str]) -> np.ndarray:
    """One row of symbol numbers per word: markers 62 and 63 around it, 0 behind it."""
    width = LONGEST + 2
    padded = "".join(("\x01" + w + "\x02").ljust(width, "\x00") for w in words)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).astype(np.int32)
    out = 31 + points % 31
    letter = (points >= 97) & (points <= 122)
    out[letter] = points[letter] - 96
    digit = (points >= 48) & (points <= 57)
    out[digit] = 27 + points[digit] % 4
    out[points == 0], out[points == 1], out[points == 2] = 0, 62, 63
    return out


def subsequences(rows: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Weight, codes and validity of the three-symbol subsequences, by the gaps between them."""
    for a, b in _OFFSETS:
        first, second, third = rows[:, :-b], rows[:, a : rows.shape[1] - b + a], rows[:, b:]
        yield DECAY ** (b + 1), (first * SYMBOLS + second) * SYMBOLS + third, third > 0


def lengths(rows: np.ndarray) -> np.ndarray:
    """The scale of each word: the root of its squared weights, which depends on its length alone."""
    total = np.zeros(len(rows))
    for weight, _, valid in subsequences(rows):
        total += weight**2 * valid.sum(1)
    return np.sqrt(np.maximum(total, 1e-12))


def linear(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scaled sum of subsequence weights per word (of at most ``LONGEST`` characters)."""
    rows = symbols(words)
    total = np.zeros(len(words))
    for weight, codes, valid in subsequences(rows):
        total += weight * (weights[codes] * valid).sum(1)
    return total / lengths(rows)


class Landmarks:
    """Landmark words by subsequence: kernel values of other words against them.

    Kept sparse, as the landmarks and weights of each known subsequence.
    """

    def __init__(self, words: list[str]):
        self.words = words
        rows = symbols(words)
        scale = lengths(rows)
        codes, owners, weights = [], [], []
        for weight, code, valid in subsequences(rows):
            owner = np.broadcast_to(np.arange(len(words))[:, None], code.shape)[valid]
            codes.append(code[valid])
            owners.append(owner)
            weights.append(weight / scale[owner])
        code, self.owner, self.weight = map(np.concatenate, (codes, owners, weights))
        order = np.argsort(code, kind="stable")
        self.owner, self.weight = self.owner[order], self.weight[order]
        self.known, first = np.unique(code[order], return_index=True)
        self.first = np.r_[first, len(code)]

    def kernel(self, words: list[str]) -> np.ndarray:
        rows = symbols(words)
        out = np.zeros(len(words) * len(self.words))
        for weight, codes, valid in subsequences(rows):
            word, column = np.nonzero(valid)
            code = codes[word, column]
            place = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            hit = self.known[place] == code
            word, place = word[hit], place[hit]
            many = self.first[place + 1] - self.first[place]
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[place], many)
            cell = np.repeat(word, many) * len(self.words) + self.owner[entry]
            out += weight * np.bincount(cell, self.weight[entry], minlength=len(out))
        return out.reshape(len(words), -1) / lengths(rows)[:, None]

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """One weight per subsequence code that gives the sum of ``alpha`` times the kernel values."""
        code = np.repeat(self.known, np.diff(self.first))
        return np.bincount(code, self.weight * alpha[self.owner], minlength=SYMBOLS**3).astype(np.float32)


def spread(words: list[str], most: int) -> list[str]:
    """Up to ``most`` words, each unlike those before it as far as there are such."""
    if len(words) <= most:
        return list(words)
    similarity = Landmarks(words).kernel(words)
    own = np.sqrt(np.maximum(np.diag(similarity), 1e-12))
    similarity = similarity / own[:, None] / own[None, :]
    nearest, chosen = np.zeros(len(words)), []
    order = np.arange(len(words)) * 1e-9  # earlier words first among equals
    for _ in range(most):
        pick = int(np.argmin(nearest + order))
        chosen.append(pick)
        nearest = np.maximum(nearest, similarity[pick])
        nearest[pick] = np.inf
    return [words[i] for i in chosen]


@dataclass
class Machine:
    """Folded weights and bias of the SVM, and the logistic curve over a document's summary."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, ...] = (0.0,) * len(SUMMARY)
    start: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        return linear(words, self.weights) + self.bias

    def summary(self, margins: np.ndarray) -> tuple[float, ...]:
        if not len(margins):
            return (self.bias,) * 3 + (0.0, 0.0)
        top = np.sort(np.partition(margins, max(0, len(margins) - 8))[-8:])[::-1]
        top = np.r_[top, np.full(8 - len(top), self.bias)]
        positive = int((margins > 0).sum())
        return float(top[0]), float(top[:3].mean()), float(top.mean()), float(np.log1p(positive)), positive / len(margins)


class _Memo:
    """Margins of recent words, kept by a worker over its batches."""

    def __init__(self, machine: Machine):
        self.machine, self.young, self.old = machine, {}, {}

    def learn(self, words: set[str]) -> dict[str, float]:
        if len(self.young) > MEMO_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    missing.append(word)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            whole = [w for w in part if len(w) <= LONGEST]
            young.update(zip(whole, self.machine.margins(whole).tolist(), strict=True))
            for word in part:
                if len(word) > LONGEST:
                    young[word] = float(self.machine.margins(_windows(word)).max())
        return young

    def of_texts(self, texts: list[str]) -> list[tuple[float, ...]]:
        split = [set(units(t.lower())) for t in texts]
        known = self.learn(set().union(*split))
        return [self.machine.summary(np.fromiter(map(known.__getitem__, u), np.float64, len(u))) for u in split]


def summary_column(text: Column, machine: Machine) -> Column:
    """The summary of the margins of a text's words, as an array in the order of ``SUMMARY``."""

    @F.pandas_udf("array<double>")
    def summaries(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Memo(machine)
        for texts in series:
            out, part, size = [], [], 0
            for text in texts:
                part.append(text or "")
                size += len(part[-1])
                if size >= SLICE_CHARS:
                    out += memo.of_texts(part)
                    part, size = [], 0
            yield pd.Series([list(x) for x in out + memo.of_texts(part)], dtype=object)

    return summaries(text)


def _training_documents(docs: DataFrame, labels: DataFrame, at_most: int) -> tuple[DataFrame, float]:
    """``doc_id, text, toxic, weight`` of the sampled documents, and the share of toxic labels."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(remainder("doc_id", 5) != 0)
    usable = written(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "usable_labels")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    kinds = []
    for kind in (0, 1):
        sample = bounded_sample(usable.filter(F.col("toxic") == kind), "doc_id", at_most, "toxicity")
        kinds.append(sample.withColumn("weight", F.lit(max(1.0, counts.get(kind, 0) / at_most))))
    sample = kinds[0].unionByName(kinds[1])  # at most twice at_most rows of three numbers
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter(F.col("text").isNotNull())
    return written(train, "toxicity_train"), counts.get(1, 0) / max(1, sum(counts.values()))


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a sentence with a hash of its neighbours."""
    for batch in batches:
        words, contexts, toxic = [], [], []
        for sentence, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = units(sentence)
            for before, word, after in zip(["", *own], own, [*own[1:], ""], strict=False):
                context = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
                for part in _windows(word):
                    words.append(part)
                    contexts.append(context)
                    toxic.append(label)
        columns = [pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "context", "toxic"])


def sentence_words(train: DataFrame) -> DataFrame:
    """``word, bad, good``: in how many surroundings the word occurs in sentences of toxic and of clean documents.

    Copies and near copies of a document repeat a word in the same surroundings, which
    count once; an insult occurs in ever new ones.
    """
    sentence = F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence")
    sentences = train.select(sentence, F.col("toxic").cast("int").alias("toxic")).filter("trim(sentence) <> ''")
    distinct = sentences.groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    words = distinct.mapInArrow(_sentence_words, "word string, context long, toxic int")
    words = words.groupBy("word", "context").agg(F.min("toxic").alias("toxic"))
    return words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _fit_svm(words: DataFrame, landmarks: Landmarks, root: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM on Nyström features of ``word, label, weight``; returns landmark coefficients and bias."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            parts = [landmarks.kernel(words[i : i + 1_000]) @ root for i in range(0, len(words), 1_000)]
            values = np.concatenate([np.zeros((0, len(root))), *parts])
            offsets = np.arange(len(values) + 1, dtype=np.int32) * len(root)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), column], names=["label", "weight", "values"])

    rows = words.select("word", "label", "weight").mapInArrow(features, "label double, weight double, values array<double>")
    rows = written(rows, "nystroem").select("label", "weight", array_to_vector("values").alias("features"))
    svm = LinearSVC(regParam=1e-4, maxIter=60, weightCol="weight", standardization=False).fit(rows)
    return root @ svm.coefficients.toArray(), float(svm.intercept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    at_most: int = TRAIN_DOCS,
    surprise: float = SURPRISE,
    ordinary: float = ORDINARY,
    words_of_kind: int = WORDS,
    landmarks_of_kind: int = LANDMARKS,
    spread_over: int = SPREAD,
) -> Machine:
    """Train on at most ``at_most`` labelled documents of each kind whose id's checksum is no multiple of 5.

    All words of these documents are counted. Those ``surprise`` deviations above chance are the positive
    examples, the ``words_of_kind`` most surprising if there are more; as many that stay below ``ordinary``,
    by hash, are the negative ones. ``landmarks_of_kind`` landmarks of each kind are taken, the positive ones spread
    over the ``spread_over`` most surprising words. None of it depends on the size of the table.
    """
    train, share = _training_documents(docs, labels, at_most)
    constant = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, start=_logit(share))
    if not 0 < share < 1:
        return constant
    words = written(sentence_words(train), "sentence_words")
    base = words.agg(F.sum("bad"), F.sum(F.col("bad") + F.col("good"))).first()
    if not base[1] or not base[0]:
        return constant
    rate = base[0] / base[1]
    seen = F.col("bad") + F.col("good")
    above = (F.col("bad") - rate * seen) / F.sqrt(seen * (rate * (1 - rate)))
    rated = written(words.withColumn("surprise", above), "rated_words")
    bad = rated.filter(F.col("surprise") >= surprise).orderBy(F.desc("surprise"), "word").limit(words_of_kind)
    positive = [r["word"] for r in bad.select("word").collect()]  # at most words_of_kind
    clean = rated.filter((F.col("surprise") < ordinary) & (F.col("good") > 0))
    clean = written(clean.select("word"), "clean_words")
    negative = clean.orderBy(F.xxhash64(F.lit("toxicity"), "word"), "word").limit(words_of_kind)
    negative = [r["word"] for r in negative.collect()]  # at most words_of_kind
    if not positive or not negative:
        return constant
    spark = docs.sparkSession
    near = Landmarks(positive[:landmarks_of_kind]).kernel(negative).max(1)  # words_of_kind x landmarks_of_kind numbers
    hard = [negative[i] for i in np.argsort(-near, kind="stable")[: landmarks_of_kind // 2]]
    machine = None
    for _ in range(2):
        chosen = list(dict.fromkeys(spread(positive[:spread_over], landmarks_of_kind) + hard + negative[: landmarks_of_kind // 2]))
        landmarks = Landmarks(chosen)
        values, vectors = np.linalg.eigh(landmarks.kernel(chosen))
        kept = values > 1e-6 * values.max()
        root = (vectors[:, kept] / np.sqrt(values[kept])) @ vectors[:, kept].T
        rows = [(w, 1.0, len(negative) / len(positive)) for w in positive] + [(w, 0.0, 1.0) for w in negative]
        alpha, bias = _fit_svm(spark.createDataFrame(rows, "word string, label double, weight double").repartition(6), landmarks, root)
        machine = Machine(landmarks.weights(alpha), bias)
        suspects = clean.withColumn("margin", summary_column(F.col("word"), machine)[0])
        suspects = [r["word"] for r in suspects.orderBy(F.desc("margin"), "word").limit(words_of_kind // 2).collect()]
        hard = suspects[: landmarks_of_kind // 2]
        negative = list(dict.fromkeys(negative + suspects))
    scored = train.select(F.col("toxic").cast("double").alias("label"), "weight", summary_column(F.col("text"), machine).alias("summary"))
    scored = written(scored, "toxicity_summaries").withColumn("features", array_to_vector("summary"))
    curve = LogisticRegression(regParam=1e-4, maxIter=100, weightCol="weight").fit(scored)
    machine.curve, machine.start = tuple(map(float, curve.coefficients)), float(curve.intercept)
    return machine


def _logit(share: float) -> float:
    if share <= 0:
        return -745.0
    return 745.0 if share >= 1 else float(np.log(share / (1 - share)))


def probability(summary: Column, machine: Machine) -> Column:
    total = F.lit(machine.start)
    for i, weight in enumerate(machine.curve):
        total = total + summary[i] * F.lit(weight)
    return 1 / (1 + F.exp(-total))


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""
    scored = docs.select("doc_id", summary_column(F.col("text"), machine).alias("summary"))
    return scored.select("doc_id", probability(F.col("summary"), machine).alias("score"))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    marked = docs.withColumn("_summary", summary_column(F.col("text"), machine))
    return marked.filter(probability(F.col("_summary"), machine) < threshold).drop("_summary")
