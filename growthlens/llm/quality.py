"""Quality: a sparse ensemble of rules over text statistics.

Statistics are Spark columns over the whole text. Trees of a small random forest,
fitted by Spark ML on a bounded sample of labelled documents, give the rules: every
path from a root to an inner or leaf node is a conjunction of thresholds. A lasso
logistic regression over the rules and the bounded statistics keeps few of them.
What is left compiles into one column expression, so scoring is a scan without a
shuffle and without Python.

Defined results: a null text counts as empty; its statistics are 0. Without labels,
or with labels of one kind, every score is the share of good labels (0.5 without
labels). Repeated rows score alike; null ids and other columns are passed over.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from growthlens.llm.common import bounded_sample, remainder, written

TRAIN_DOCS = 8_000  # labelled documents in the sample
TREES, DEPTH = 24, 3
LASSO = 0.001
MARKS = {"bang": "!", "bar": "|", "hash": "#", "dollar": "$", "percent": "%", "amp": "&", "star": "*", "comma": ",", "stop": "."}


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with one double column per statistic of the text, and the names of these columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.withColumns(
        {
            "_words": F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_lines": F.split(t, "\n"),
            "_length": F.char_length(t),
            "_bytes": F.octet_length(t),
        }
    )
    words = F.greatest(F.size("_words"), F.lit(1)).cast("double")
    length = F.greatest(F.col("_length"), F.lit(1)).cast("double")
    out = {
        "s_words": F.log1p(F.size("_words").cast("double")),
        "s_word_length": F.col("_length") / words,
        "s_distinct_words": F.size(F.array_distinct("_words")) / words,
        "s_distinct_lines": F.size(F.array_distinct("_lines")) / F.size("_lines"),
        "s_words_per_line": F.log1p(words / F.size("_lines")),
        "s_upper": F.regexp_count(t, F.lit("[A-ZÀ-Þ]")) / length,
        "s_digits": F.regexp_count(t, F.lit("[0-9]")) / length,
        "s_wide": (F.col("_bytes") - F.col("_length")) / length,
    }
    for name, mark in MARKS.items():
        out[f"s_{name}"] = (F.col("_length") - F.char_length(F.replace(t, F.lit(mark), F.lit("")))) / words
    return base.withColumns(out).drop("_words", "_lines", "_length", "_bytes"), list(out)


Condition = tuple[int, str, float]  # position of the statistic, "<=" or ">", threshold
Rule = tuple[Condition, ...]


def rules_of(description: str) -> list[Rule]:
    """The distinct path prefixes of the trees in Spark ML's description of a model, in order of appearance."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        match = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not match:
            if re.match(r" *Tree \d+", line):
                path = []
            continue
        depth = len(match[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(match[2]), match[3], float(match[4])))]
        found[_tidy(tuple(c for _, c in path))] = None
    return list(found)


def _tidy(rule: Rule) -> Rule:
    """The same conjunction with one threshold per statistic and direction."""
    tightest: dict[tuple[int, str], float] = {}
    for feature, sign, value in rule:
        old = tightest.get((feature, sign))
        tightest[feature, sign] = value if old is None else (min if sign == "<=" else max)(old, value)
    return tuple(sorted((f, s, v) for (f, s), v in tightest.items()))


def condition(rule: Rule, names: list[str]) -> Column:
    """A rule as a boolean column."""
    out = F.lit(True)
    for feature, sign, value in rule:
        column = F.col(names[feature])
        out = out & ((column <= value) if sign == "<=" else (column > value))
    return out


@dataclass
class RuleEnsemble:
    """The rules that the lasso kept, with their weights."""

    names: list[str]
    start: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[int, float, float, float]]  # statistic, weight, lowest, highest

    def score(self) -> Column:
        """Probability of good quality, as one expression over the statistics."""
        total = F.lit(self.start)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, self.names), weight).otherwise(0.0)
        for feature, weight, low, high in self.linear:
            total = total + F.greatest(F.lit(low), F.least(F.lit(high), F.col(self.names[feature]))) * weight
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = TRAIN_DOCS) -> RuleEnsemble:
    """Learn from at most ``at_most`` labelled documents whose id's checksum is no multiple of 5."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(remainder("doc_id", 5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    sample = bounded_sample(written(usable, "usable_labels"), "doc_id", at_most, "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most at_most rows of two numbers
    rows, names = statistics(rows)
    rows = written(rows.select("label", *names), "quality_train")
    share = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
    if not share[1] or share[0] in (0.0, 1.0):
        p = min(max(share[0] if share[1] else 0.5, 1e-9), 1 - 1e-9)
        return RuleEnsemble(names, math.log(p / (1 - p)), [], [])
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, subsamplingRate=0.7, minInstancesPerNode=4)
    rules = rules_of(forest.fit(assembled).toDebugString)
    bounds = rows.select(*[F.percentile(n, F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in names]).first()
    terms = [F.when(condition(r, names), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)]
    terms += [F.greatest(F.lit(bounds[n][0]), F.least(F.lit(bounds[n][1]), F.col(n))).alias(n) for n in names]
    inputs = [f"r{i}" for i in range(len(rules))] + names
    applied = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows.select("label", *terms)).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=80).fit(applied)
    weights = lasso.coefficients.toArray().tolist()
    kept = [(r, w) for r, w in zip(rules, weights, strict=False) if w]
    linear = [(i, w, *map(float, bounds[n])) for i, (n, w) in enumerate(zip(names, weights[len(rules) :], strict=True)) if w]
    return RuleEnsemble(names, float(lasso.intercept), kept, linear)


def quality(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""
    rows, _ = statistics(docs.select("doc_id", "text"))
    return rows.select("doc_id", model.score().alias("score"))
