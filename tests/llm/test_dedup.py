"""Exact and SimHash deduplication against brute force."""

import hashlib
import random

import pyspark.sql.functions as F
import pytest
import xxhash

from growthlens.llm.common import WHITE_SPACE
from growthlens.llm.components import components
from growthlens.llm.exact_dedup import exact_dedup, keep_first_copies
from growthlens.llm.simhash import fingerprint_links, fingerprint_of, keep_representatives, simhash_classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id int"


def strip(text):
    for c in WHITE_SPACE:
        text = (text or "").replace(c, "")
    return text


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), i is None, i if i is not None else 0))
    out, taken = [], set()
    for i, t in rows:
        best = min(groups[strip(t)])
        keep = None if best[1] else best[2]
        kept = i == keep and len(t or "") == -best[0] and strip(t) not in taken
        taken |= {strip(t)} if kept else set()
        out.append((i, keep, len(groups[strip(t)]), kept, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab cd é".split()) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r"), (203, "x" * 300_000), (204, "x" * 150_000 + "\n" + "x" * 150_000)]
    rows += [(300, "same row"), (300, "same row"), (None, "no id"), (None, "no id"), (301, "no  id"), (None, "alone"), (302, "a b"), (303, "ab")]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "clash", 7) for i, t in rows], DOCS)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force_even_under_collisions(spark, weak):
    rows = cases()
    args = {"hashed": lambda norm: F.substring(F.md5(norm), 1, 1)} if weak else {}
    got = exact_dedup(documents(spark, rows), **args).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_dedup(rows)


def test_kept_rows_keep_their_columns_and_one_row_per_text(spark):
    docs = documents(spark, cases())
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [strip(r["text"]) for r in rows]
    assert len(texts) == len(set(texts)) and set(texts) == {strip(t) for _, t in cases()}
    by_text = {strip(r["text"]): r["doc_id"] for r in rows}
    assert by_text["noid"] == 301 and by_text["x" * 300_000] == 204 and by_text["alone"] is None


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert exact_dedup(docs).count() == 0 and keep_first_copies(docs).count() == 0 and simhash_classes(docs).count() == 0


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE_SPACE:
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, links):
    """rows: (id, fingerprint); smallest id that chains of links reach."""
    best = {f: f for _, f in rows}

    def root(f):
        while best[f] != f:
            f = best[f]
        return f

    for a in best:
        for b in best:
            if links(a, b):
                best[root(a)] = root(b)
    ids = {}
    for i, f in rows:
        ids.setdefault(root(f), []).append(i)
    return {i: min(x for x in ids[root(f)] if x is not None) for i, f in rows if i is not None}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(40)] + ["Word", "WORD"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for j in range(3):
            text = list(base)
            if text and j:
                text[rng.randrange(len(text))] = "changed"
            rows.append((i * 3 + j, rng.choice([" ", "\n", "\t\x0b"]).join(text)))
    rows += [(900, None), (901, " "), (902, "Long word " * 40_000), (903, "long WORD\n" * 40_000)]
    want = [(i, plain_fingerprint(t, 3)) for i, t in rows]
    assert [fingerprint_of(t, 3) for _, t in rows] == [f for _, f in want]
    got = {r["doc_id"]: r["component_id"] for r in simhash_classes(documents(spark, rows)).collect()}
    assert got == brute_components(want, lambda a, b: (a ^ b).bit_count() <= 3)


@pytest.mark.parametrize("bucket_rows", [8_192, 64])
def test_links_of_crowded_blocks_and_chains(spark, bucket_rows):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)}
    hot = rng.getrandbits(64)
    fps |= {hot ^ (rng.getrandbits(20) << 30) for _ in range(150)}  # three of four blocks agree
    chain = rng.getrandbits(64)
    for i in range(0, 60, 3):
        fps.add(chain := chain ^ (7 << i))
    for f in list(fps)[:80]:
        for _ in range(2):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in components(fingerprint_links(frame, 3, bucket_rows)).collect()}
    got = {}
    for (s,), f in zip(signed, fps, strict=True):
        got.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for i, c in brute_components([(f, f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 3).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_null_ids_and_repeated_rows_share_a_component(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A  B c d"), (None, "alone here now")]
    got = sorted(map(tuple, simhash_classes(documents(spark, rows)).select("doc_id", "component_id").collect()), key=repr)
    assert got == [(4, 4), (4, 4), (9, 4), (None, 4), (None, None)]


def test_one_row_of_each_component_stays_with_repeated_ids(spark):
    other = "wholly different words stand in this unlike text of its own"
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, other), (2, "a b c d e")]
    rows += [(5, "x y z"), (5, "x y z"), (6, "q r s t"), (7, "Q R S T"), (None, "a b c d e")]
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"], r["text"]) for r in keep_representatives(docs).collect()), key=repr)
    assert got == sorted([(1, "a b c d e"), (2, other), (5, "x y z"), (6, "q r s t"), (None, "a b c d e")], key=repr)
    assert keep_representatives(docs).columns == docs.columns
    assert keep_representatives(docs.limit(0)).count() == 0


def test_of_rows_that_share_an_id_one_is_kept(spark):
    rows = [(5, "same text"), (5, "same  text "), (5, "same  text "), (6, "same text"), (None, "zz"), (None, "zz"), (8, "alone")]
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(documents(spark, rows)).collect()]
    want = [(5, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True), (6, 5, 4, False), (None, None, 2, False), (None, None, 2, True), (8, 8, 1, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
