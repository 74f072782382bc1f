"""Surrogates against their promises; neighbours against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthlens.llm import ann, pii
from growthlens.llm.queries import op6_neighbours

TEXTS = [
    "call +1 (509) 555-6973 or +1 509-555-6973, mail inhe.83@mail0.example.com INHE.83@MAIL0.EXAMPLE.COM!! x",
    "ip 106.158.249.239 and 8.8.8.8.",
    "card 4111 1111 1111 1111 4111111111111111 4264645872074229",
    'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"### 078-05-1120',
    "Mrs. Anna Müller met Herr Schmidt and Госпожа Анна Петрова; again Mrs. Anna Müller",
    None, "", "nothing 12 a@b x.y", "z" * 100_000 + " 8.8.8.8 " + "@" * 50_000,
]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(i, t, "clash", 1, "d") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "clash", 1, "d"), (None, TEXTS[1], "c", 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, raw int, surrogate string")
    return docs, pii.pseudonymise(docs).collect()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def test_surrogates_keep_type_format_and_reference(replaced):
    docs, rows = replaced
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(TEXTS) + 2 and out[5] is None and out[6] == "" and out[7] == TEXTS[7]
    phones = re.findall(r"\+1 (?:\(\d{3}\) |\d{3}-)\d{3}-\d{4}", out[0])
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    mails = re.findall(r"\S+@\S+?\.(?:com|COM)", out[0])
    assert len(mails) == 2 and mails[0].upper() == mails[1] and mails[0].islower() and re.match(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.", mails[0])
    octets = [list(map(int, a.split("."))) for a in re.findall(r"\d+\.\d+\.\d+\.\d+", out[1])]
    assert len(octets) == 2 and all(0 <= x < 256 for a in octets for x in a)
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[2])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and luhn("4111111111111111")
    assert luhn(cards[2]) == luhn("4264645872074229")
    assert re.search(r'token = "[0-9a-f]{40}"### \d{3}-\d\d-\d{4}$', out[3])
    names = re.match(r"Mrs\. (\w+ \w+) met Herr (\w+) and Госпожа (\w+ \w+); again Mrs\. (\w+ \w+)$", out[4])
    assert names[1] == names[4] and names[1].split()[0][0].isupper() and names[1].endswith("r") and names[3].endswith("а")
    assert re.fullmatch(r"[А-Яа-я]+ [А-Яа-я]+", names[3])
    assert out[8].startswith("z" * 100_000 + " ") and out[8].endswith(" " + "@" * 50_000)
    for text, new in ((TEXTS[i], out[i]) for i in range(7)):
        for secret in re.findall(r"\S*\d{3}\S*|\w+@\S+|8\.8\.8\.8|Müller|Schmidt|Петрова", text or ""):
            assert secret not in new, secret


def test_repeated_rows_and_other_columns(replaced):
    docs, rows = replaced
    assert set(docs.columns) <= set(rows[0].asDict())
    assert {r["text"] for r in rows if r["kinds"] == "ip ip"} == {next(r["text"] for r in rows if r["doc_id"] == 1)}
    assert all(r["kind"] in ("clash", "c") and r["raw"] == 1 for r in rows)


def test_permutation_is_one_to_one_and_keyed(spark):
    raws = spark.range(3_000).select(F.concat(F.lit("555-"), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("-0000")).alias("raw")).distinct()
    raws = raws.unionByName(spark.range(2_000).select(F.concat_ws(".", F.lit(10), F.lit(0), (F.col("id") / 256).cast("int"), F.col("id") % 256).alias("raw")))
    found = pii.surrogates(raws, "k1")
    assert pii.clashes(found).filter("n > 1").count() == 0
    assert found.select("surrogate").distinct().count() == raws.count()
    other = pii.surrogates(raws, "k2").withColumnRenamed("surrogate", "again").select("raw", "again")
    assert found.join(other, "raw").filter("surrogate = again").count() < 5


def test_a_key_with_an_unchanged_entity_is_passed_over(spark):
    docs = spark.createDataFrame([(i, f"Mr. A{c}") for i, c in enumerate("bcdfgh")], "doc_id int, text string")
    key = pii.checked_key(docs)
    raws = pii.entities(docs)
    n = [pii.clashes(pii.surrogates(raws, f"{pii.KEY}/{i}")).filter("n > 1").count() for i in range(pii.TRIES)]
    assert n[int(key.rsplit("/")[-1])] == min(n)
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_addresses_behind_marks_and_long_secrets(spark):
    marked = ["_john@x.com_", "-john@x.com", "...john@x.com", "%20john@x.com", "+john@x.com", "john@x.com"]
    secrets = ["0aF" * 43, "9c8b" * 128, "e0" * 2_000]
    docs = spark.createDataFrame(list(enumerate(marked + [f"key {s}." for s in secrets])), "doc_id int, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    for i, text in enumerate(marked):
        assert out[i]["n_entities"] == 1 and out[i]["kinds"] == "email" and "john@x" not in out[i]["text"] and len(out[i]["text"]) == len(text)
    assert out[2]["text"] == "..." + out[5]["text"] and out[1]["text"] == "-" + out[5]["text"] and out[0]["text"] == f"_{out[5]['text']}_"
    for i, secret in enumerate(secrets, len(marked)):
        new = re.fullmatch(r"key ([0-9a-fA-F]+)\.", out[i]["text"])[1]
        assert out[i]["kinds"] == "secret" and len(new) == len(secret) and new != secret
        assert [c.isupper() for c in secret if c.isalpha()] != [] and secret[:32] not in new


def test_one_person_stays_one_person(spark):
    text = "Mr. John Smith met Mr. Smith. Later Smith and JOHN, not Smithy, saw MR. SMITH-JONES; Ms. Գրիգորյան, Mr. Şükrü İnan."
    docs = spark.createDataFrame([(1, text), (2, "Smith alone stays"), (3, "Mr. 王小明 and Mr. Smith")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    out = rows[1]["text"]
    found = re.match(
        r"Mr\. (\w+) (\w+) met Mr\. (\w+)\. Later (\w+) and (\w+), not Smithy, saw MR\. ([A-Z]+-[A-Z]+); Ms\. (\w+), Mr\. (\w+) (.+)\.$", out
    )
    given, surname = found[1], found[2]
    assert surname == found[3] == found[4] != "Smith" and given != "John" and found[5] == "JOHN"
    assert surname.endswith("h") and given.endswith("n") and found[7] != "Գրիգորյան" and not found[8].startswith("Ş" "ük")
    assert "SMITH" not in out and rows[1]["kinds"] == "name name name name name" and rows[1]["n_kept"] == 0
    assert rows[2]["text"] == "Smith alone stays" and rows[3]["text"].startswith("Mr. 王小明 and Mr. ") and surname in rows[3]["text"]


def test_words_of_names_are_replaced_one_to_one(spark):
    """Brute force: over all words of two letters and more, equal words and only those have equal surrogates."""
    import itertools

    words = ["".join(w).capitalize() for n in (2, 3) for w in itertools.product("abeмян", repeat=n)]
    docs = spark.createDataFrame([(i, f"Mr. {w} {words[-1 - i]}") for i, w in enumerate(words)], "doc_id int, text string")
    seen = {}
    for r in pii.pseudonymise(docs).collect():
        for old, new in zip([words[r["doc_id"]], words[-1 - r["doc_id"]]], r["text"].split()[1:], strict=True):
            assert seen.setdefault(old, new) == new and new != old and len(new) == len(old) and new[-1] == old[-1]
    assert len(set(seen.values())) == len(seen) == len(words)


def test_texts_of_a_megabyte_of_every_pattern(spark):
    texts = ["x@" + "a." * 300_000 + "com", "a" * 1_000_000 + "@x.com", "Mr. " + "A" + "b" * 500_000, "Mr. " + "Ab " * 200_000]
    texts += ["9" * 1_000_000, "1-" * 300_000, "1.2." * 200_000, "ab1" * 300_000, "x@a.b " * 50_000, "@" * 500_000, "(555) " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    assert all(len(out[i]["text"]) == len(t) for i, t in enumerate(texts) if out[i]["kinds"] != "ip")
    assert out[0]["kinds"] == out[1]["kinds"] == "email" and out[0]["text"] != texts[0] and out[0]["text"].endswith(".com")
    assert out[2]["kinds"] == out[3]["kinds"] == "name" and out[7]["kinds"] == "secret"


def test_no_short_name_keeps_its_value(spark):
    import string

    names = [f"Mr. {a}{b}i" for a in string.ascii_uppercase for b in ["", *string.ascii_lowercase]]
    raws = spark.createDataFrame([(n,) for n in names], "raw string")
    for key in ("k1", "k2"):
        found = pii.surrogates(raws, key)
        assert pii.clashes(found).count() == 0
        assert found.select("surrogate").distinct().count() == len(names)


def test_surrogates_stay_native(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id int, text string")
    plan = pii.replace_entities(docs, "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows, query, count=10):
    own = next(v for i, v in rows if i == query)
    near = sorted((float(np.sqrt(((np.float64(v) - np.float64(own)) ** 2).sum())), i) for i, v in rows if i != query)
    return near[:count]


def check(frame, rows, queries, least):
    got = {}
    for r in frame.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hit = total = 0
    for q in queries:
        want = brute(rows, q)
        found = [(s, v) for _, s, v in sorted(got.get(q, []))]
        assert len(found) == len(want) and found == sorted(found)
        exact = {i: s for s, i in brute(rows, q, len(rows))}
        assert all(s == pytest.approx(exact[v], rel=1e-12) for s, v in found)
        hit += len({v for _, v in found} & {v for _, v in want})
        total += len(want)
    assert set(got) <= set(queries) and hit >= least * total


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_graph_rounds_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "GROUP", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).astype(np.float32)) for i in range(900)]
    check(ann.nearest(vectors(spark, rows)), rows, range(0, 900, 100), 0.9)


def test_outliers_and_cut_cells_start_with_full_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 24))
    rows = [(i, (centres[i % 4] + 0.01 * rng.normal(size=24)).astype(np.float32)) for i in range(1_200)]
    rows += [(2_000 + i, (3 * rng.normal(size=24)).astype(np.float32)) for i in range(40)]  # far from all and from one another
    nodes, kind = ann._packed(vectors(spark, rows).selectExpr("vec_id as id", "embedding as vector"))
    lists = ann._first_lists(nodes, len(rows), 8, kind).select("u", "v").distinct().collect()
    near, met = {i: set() for i, _ in rows}, {i: set() for i, _ in rows}
    for u, v in lists:
        near[u].add(v)
        met[u].add(v)
        met[v].add(u)
    assert min(map(len, near.values())) >= 8
    for group in range(4):  # the parts of a crowded cell hang together
        reached = todo = {group}
        while todo:
            todo = {v for u in todo for v in met[u] if v < 2_000 and v % 4 == group} - reached
            reached = reached | todo
        assert len(reached) == 300


@pytest.mark.parametrize("sigma", [1e-4, 1e-5])
def test_near_copies_and_a_row_of_large_values(spark, sigma):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(4, 16))
    rows = [(i, (centres[i % 4] + sigma * rng.normal(size=16)).astype(np.float32)) for i in range(400)]
    rows.append((400, np.float32([1e7] + [0.5] * 15)))
    check(ann.nearest(vectors(spark, rows)), rows, range(0, 500, 100), 0.99)


def test_squared_distances_keep_their_digits():
    rng = np.random.default_rng(14)
    x = 1.0 + 1e-7 * rng.normal(size=(50, 8))
    x[7, 0] = 1e7
    x = np.concatenate([x[7:8], x])
    want = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    assert ann._squares(x) == pytest.approx(want, rel=1e-6, abs=1e-22)


def test_small_tables_ties_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=6).astype(np.float32)
    good = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=6).astype(np.float32)) for i in range(40)]
    bad = [(200, None), (300, [0.0] * 6), (400, [float("nan")] + [1.0] * 5), (500, [float("inf")] * 6), (600, [None] + [1.0] * 5), (700, [1.0] * 5), (None, same), (800, [])]
    check(ann.nearest(vectors(spark, good + bad)), good, [0, 100], 1.0)
    for n in (0, 1, 2, 4):
        few = good[58 : 58 + n] if n else []
        few = [(i * 100, v) for i, (_, v) in enumerate(few)]
        check(ann.nearest(vectors(spark, few)), few, [i for i, _ in few] if n > 1 else [], 1.0)
    twice = [*good, good[0], good[70]]
    check(ann.nearest(vectors(spark, twice)), good, [0, 100], 1.0)


def test_search_of_the_registered_query(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    rows = [(r["vec_id"], np.float32(r["embedding"])) for r in table]
    check(op6_neighbours(spark, folder), rows, [i for i, _ in rows if i % 100 == 0], 0.9)
