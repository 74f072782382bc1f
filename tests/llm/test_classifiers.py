"""Quality, toxicity and language models: held-out accuracy, exact parts, and odd inputs."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import langid, quality, toxicity
from growthlens.llm.common import bounded_sample, remainder, table

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
ODD = [None, "", "   ", "12 34 !!", "word", "word", "x" * 200_000, "é " * 60_000, "漢字 かな", "a b c d e"]


def odd_documents(spark):
    rows = [(i if i != 4 else None, t, "clash", 0.5, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, margin int")


def shares(rows, label):
    hit = {(r[label], r["predicted"]): r["n"] for r in rows}
    return hit.get((1, 1), 0), hit.get((1, 0), 0), hit.get((0, 1), 0), hit.get((0, 0), 0)


@needs_data
def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = quality.fit(docs, labels)
    assert model.rules and len(model.rules) < 200
    scored = quality.quality(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0)
    got = scored.groupBy("quality", (F.col("score") >= 0.3).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    good, lost, passed, caught = shares(got.collect(), "quality")
    assert good >= 0.95 * (good + lost) and caught >= 0.7 * (caught + passed)
    odd = quality.quality(odd_documents(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


def test_rules_are_the_path_prefixes_of_the_trees(spark):
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 2 <= 0.25)
      Predict: 0.0
     Else (feature 2 > 0.25)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""
    assert quality.rules_of(text) == [
        ((2, "<=", 0.5),), ((2, "<=", 0.25),), ((2, "<=", 0.5), (2, ">", 0.25)), ((2, ">", 0.5),),
    ]


def test_statistics_by_hand(spark):
    docs = spark.createDataFrame([(1, "Aé b!! b\nAé b!! b")], "doc_id long, text string")
    row = quality.statistics(docs)[0].first()
    assert row["s_distinct_words"] == 3 / 6 and row["s_distinct_lines"] == 0.5 and row["s_bang"] == 4 / 6
    assert row["s_upper"] == pytest.approx(2 / 17) and row["s_wide"] == pytest.approx(2 / 17)


def plain_statistics(text):
    """The statistics of a text, by definition and in their order."""
    t = text or ""
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = t.split("\n")
    words, length = max(1, len(found)), max(1, len(t))
    out = [math.log1p(len(found)), len(t) / words, len(set(found)) / words, len(set(lines)) / len(lines), math.log1p(words / len(lines))]
    out += [len(re.findall("[A-ZÀ-Þ]", t)) / length, len(re.findall("[0-9]", t)) / length, (len(t.encode()) - len(t)) / length]
    return out + [t.count(mark) / words for mark in quality.MARKS.values()]


def test_compiled_scores_equal_direct_evaluation_of_the_rules(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["river", "house", "Green", "was", "old,", "walked."], 25)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY", "$$$", "now!!", "9%", "click|", "#1"], 25)) + "\nBUY\nBUY" for _ in range(60)]
    mixed = [f"{a}\n{b}" for a, b in zip(good[:20], bad[:20], strict=True)]
    rows = [(i, t) for i, t in enumerate(good + bad + mixed + ODD)] + [(None, good[0]), (3, bad[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs.filter("doc_id < 120"), labels)
    third = (tuple((f, "<=", v) for f, v in ((0, 3.4), (5, 0.2))), -0.75)
    by_hand = quality.RuleEnsemble(model.names, 0.25, [(((7, ">", 0.0),), 1.5), third], [(1, -0.125, 2.0, 6.0), (8, 0.5, 0.0, 0.4)])
    assert model.rules or model.linear
    for ensemble in (model, by_hand):
        want = []
        for i, text in rows:
            x, total = plain_statistics(text), ensemble.start
            for rule, weight in ensemble.rules:
                total += weight * all(x[f] <= v if sign == "<=" else x[f] > v for f, sign, v in rule)
            total += sum(w * max(low, min(high, x[f])) for f, w, low, high in ensemble.linear)
            want.append((str(i), 1 / (1 + math.exp(-total))))
        got = [(str(r["doc_id"]), r["score"]) for r in quality.quality(docs, ensemble).collect()]
        assert [k for k, _ in sorted(got)] == [k for k, _ in sorted(want)]
        assert [v for _, v in sorted(got)] == pytest.approx([v for _, v in sorted(want)], abs=1e-12)


@needs_data
def test_toxicity_on_held_out_documents_and_disguised_insults(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.fit(docs, labels)
    scored = toxicity.toxicity(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0)
    got = scored.groupBy("toxic", (F.col("score") >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    caught, lost, wrong, clean = shares(got.collect(), "toxic")
    assert caught >= 0.4 * (caught + lost) and clean >= 0.95 * (clean + wrong)
    plain, ordinary = model.margins(["idiot"])[0], model.margins(["then"])[0]
    memo = toxicity._Memo(model)
    for disguised in ("i d i o t", "i.d.i.o.t", "idi*ot", "IDIOT!!", "idioot", "id1iot"):
        assert memo.of_texts([disguised])[0][0] > (plain + ordinary) / 2, disguised
    odd = toxicity.toxicity(odd_documents(spark), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.drop_toxic(odd_documents(spark), model)
    assert kept.columns == odd_documents(spark).columns and kept.filter("text is null").count() == 1


def plain_kernel(a, b):
    """Weighted common subsequences of three symbols, by definition."""

    def spectrum(word):
        row = toxicity.symbols([word])[0]
        row = row[row > 0]
        out = {}
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                for k in range(j + 1, min(len(row), i + toxicity.SPAN)):
                    key = (row[i], row[j], row[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = spectrum(a), spectrum(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_equals_its_definition():
    words = ["idiot", "i*diot", "loser", "aaaa", "z", "überlänge"]
    landmarks = toxicity.Landmarks(words[:4])
    values = landmarks.kernel(words)
    scale = toxicity.lengths(toxicity.symbols(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words[:4]):
            assert values[i, j] == pytest.approx(plain_kernel(a, b) / scale[i] / scale[j])
    alpha = np.array([1.0, -2.0, 0.5, 3.0])
    assert toxicity.linear(words, landmarks.weights(alpha)) == pytest.approx(values @ alpha, rel=1e-5, abs=1e-6)


def test_toxicity_and_quality_without_usable_labels(spark):
    docs = odd_documents(spark)
    for rows in ([], [(None, 1, 1)], [(0, None, None), (1, 1, 1), (2, 1, 1), (3, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert toxicity.toxicity(docs, toxicity.fit(docs, labels)).count() == len(ODD)
        assert quality.quality(docs, quality.fit(docs, labels)).count() == len(ODD)
    empty = docs.limit(0)
    assert toxicity.toxicity(empty, toxicity.fit(empty, labels)).count() == 0


@needs_data
def test_language_on_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    model = langid.fit(docs, at_most=400)
    held = docs.filter(remainder("doc_id", 4) == 2)
    found = langid.predict(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.97 * held.count()
    odd = {r["doc_id"]: r for r in langid.predict(odd_documents(spark), model).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and odd[0]["score"] == 0
    assert odd[8]["lang_pred"] in model.names + ["und"] and odd[None]["lang_pred"] in model.names
    strict = langid.predict(held, model, max_distance=0.01)
    assert strict.filter("rejected").count() == strict.filter("lang_pred = 'und'").count() > 0


def plain_language(text, model):
    """Nearest centroid, by dictionaries of n-grams and a loop over all centroids."""
    symbols = [b if b >= 128 or 97 <= b <= 122 else 0 for b in (text or "").lower().encode()]
    symbols = [b for i, b in enumerate(symbols) if b or i == 0 or symbols[i - 1]]
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(symbols) - n + 1):
            if n > 1 or symbols[i]:
                code = 0
                for b in symbols[i : i + n]:
                    code = code * 257 + b
                place = (code * 2654435761 >> 11) % langid.DIMENSIONS
                counts[place] = counts.get(place, 0) + 1
    weights = {k: math.log1p(n) * model.idf[k] for k, n in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    if not length or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    found = []
    for owner, centroid in zip(model.language, model.vectors, strict=True):
        cosine = sum(w * centroid[k] for k, w in weights.items()) / length
        found.append((-round(cosine, 9), model.names[owner]))
    best = min(found)
    return best[1], -best[0]


def test_languages_equal_brute_force_over_all_centroids(spark):
    rng = np.random.default_rng(6)
    words = {"aa": ["the", "house", "river", "is", "old"], "bb": ["das", "haus", "über", "fluß", "alt"], "cc": ["la", "maison", "été", "où", "vieux"]}
    rows = [(i, " ".join(rng.choice(words[n], 12)), n) for i, n in enumerate(list(words) * 40)]
    rows += [(1_000 + i, " ".join(rng.choice(sum(words.values(), []), 9)), None) for i in range(60)]
    docs = spark.createDataFrame(rows + [(2_000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.names == ["aa", "bb", "cc"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, model).collect():
        name, score = plain_language(texts[r["doc_id"]], model)
        assert (r["lang_pred"], r["score"]) == (name, pytest.approx(score, abs=1e-8)), r["doc_id"]
        if name != "und" and abs(1 - score - model.bounds[name]) > 1e-6:
            assert r["rejected"] == (1 - score > model.bounds[name])


def test_noise_is_rejected_by_the_learned_bound(spark):
    words = ["the", "house", "and", "river", "is", "old", "green", "water"]
    rows = [(i, " ".join(words[(i * k + k) % 8] for k in range(30)), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    noise = spark.createDataFrame([(1, "zxqj kvvq xzzq jqk " * 8), (2, rows[2][1])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.predict(noise, model).collect()}
    assert found[1]["rejected"] and found[1]["lang_pred"] == "en" and found[1]["score"] < found[2]["score"]
    assert langid.predict(docs, model).filter("not rejected").count() > 50


def test_language_without_training_rows(spark):
    docs = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "only one", "xx"), (2, None, "yy"), (5, "", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(one, langid.fit(one)).collect()} <= {"xx", "und"}


def test_bounded_sample_keeps_its_bound(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "doc_id")
    assert 300 < bounded_sample(rows, "doc_id", 500, "x").count() <= 500
    assert bounded_sample(rows, "doc_id", 9_000, "x").count() == 5_000
