"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib
import random

import pytest

from growthlens.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.Vocabulary(bpe.read_ranks(file.read()), P.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    table = vocabulary.whole
    assert table.size == len(vocabulary.ranks) and sorted(table.values) == sorted(vocabulary.ranks.values())
    assert all(table.get(k) == v for k, v in vocabulary.ranks.items())
    assert table.get(b"not a token of it") == -1 and table.get(b"") == -1


def test_tiny_vocabularies():
    for n in (0, 1, 2, 3):
        table = bpe.PerfectHash([bytes([i]) for i in range(n)], list(range(n)))
        assert [table.get(bytes([i])) for i in range(4)] == [i if i < n else -1 for i in range(4)]


def test_encoding_equals_the_library(vocabulary, reference):
    rng = random.Random(3)
    pool = "aBz é ß \x1c\x1f\x85\x0b\x0c\t\n\r 　 '’s'll 12½Ⅷ三あ😀🏽‍́_-<|endoftext|>"
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        ids = vocabulary.encode(text)
        assert ids == reference.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def test_one_very_long_piece(vocabulary, reference):
    for text in ("a" * 3_000, "ab" * 900, "é" * 500, " " * 2_000, "xyzzy" * 300):
        assert vocabulary.encode(text) == reference.encode_ordinary(text)


def test_memo_generations_change_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    text = "unheard wordles unheard strangelings of unheard wordles " * 5
    assert vocabulary.encode(text) == reference.encode_ordinary(text)


def test_operator_over_a_table(spark, reference):
    texts = [None, "", "Hello world", "Hello world", "äöü " * 9_000]
    rows = [(i if i != 3 else None, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t, _ in rows}
    assert bpe.digests(docs.limit(0)).count() == 0
