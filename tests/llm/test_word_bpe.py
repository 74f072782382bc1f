"""Backtracking BPE against the tokenizers library and against merging by rank."""

import hashlib
import json
import random
import unicodedata

import pytest

from growthlens.llm import word_bpe

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return word_bpe.WordVocabulary(file.read())


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


def same(vocabulary, reference, text):
    ids = reference.encode(text, add_special_tokens=False).ids
    decoded = b"".join(vocabulary.decoded(ids)).decode()
    return vocabulary.encode(text) == ids and decoded == reference.decode(ids, skip_special_tokens=False)


def merged_by_rank(merges, word):
    """The definition: apply the earliest merge, leftmost first, until none applies."""
    number = {s: n for n, s in enumerate(merges.symbols[: merges.first_merge])}
    parts = [number[c] for c in word]
    while True:
        found = [(merges.pairs[p], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (p := a * merges.size + b) in merges.pairs]
        if not found:
            return parts
        n, i = min(found)
        parts[i : i + 2] = [n]


def test_random_merge_tables_give_the_result_of_merging_by_rank():
    rng = random.Random(5)
    for _ in range(150):
        symbols, merges, seen = list("abc"), [], set("abc")
        for _ in range(rng.randint(0, 14)):
            a, b = rng.randrange(len(symbols)), rng.randrange(len(symbols))
            if symbols[a] + symbols[b] not in seen and len(symbols[a] + symbols[b]) < 9:
                merges.append((a, b))
                symbols.append(symbols[a] + symbols[b])
                seen.add(symbols[-1])
        table = word_bpe.Merges(list("abc"), merges)
        for _ in range(60):
            word = "".join(rng.choice("aab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(1, 25)))
            assert table.encode(word) == merged_by_rank(table, word), (merges, word)


def test_longest_match_at_every_place(vocabulary):
    merges = vocabulary.merges
    entries = set(merges.symbols)
    for word in ("internationally", "thethethe", "zzxqj"):
        for i, n in enumerate(merges.longest(word)):
            longest = next(word[i:j] for j in range(len(word), i, -1) if word[i:j] in entries)
            assert merges.symbols[n] == longest


def test_every_entry_that_is_in_use_encodes_to_itself(vocabulary):
    merges = vocabulary.merges
    assert all(merges.encode(s) == [n] for n, s in enumerate(merges.symbols[:20_000]))


def test_random_texts(vocabulary, reference):
    rng = random.Random(3)
    pool = "aBz é ß \x1c\x1f\x85\x0b\x0c\t\n\r 　 '’s'll 12½Ⅷ三あ😀🏽‍́_-ΣςİǅſK"
    entries = [k.removesuffix("</w>") for k in reference.get_vocab()]
    for k in range(3_000):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(entries) for _ in range(rng.randint(0, 25)))
        text += "<|endoftext|>x" if k % 9 == 0 else ""
        assert same(vocabulary, reference, text), text


def test_all_characters_alone_and_in_context(vocabulary, reference):
    for start in [*range(0, 0x3400, 16), *range(0xA480, 0xFB00, 64), *range(0xFB00, 0x1FC00, 16)]:
        text = "".join(f"x{chr(c)}1{chr(c)}! " for c in range(start, start + 16) if not 0xD800 <= c < 0xE000)
        assert same(vocabulary, reference, text), hex(start)


def test_combining_marks_the_library_orders_otherwise(vocabulary, reference):
    for c in map(chr, range(0x300, 0x1F000)):
        if unicodedata.combining(c):
            assert same(vocabulary, reference, f"ạ{c}́ a{c}̴ x")


def test_words_of_great_length(vocabulary, reference):
    for text in ("a" * 30_000, "ab" * 9_000, "é" * 5_000, "xyzzy" * 3_000, "Σ" * 2_000):
        assert same(vocabulary, reference, text)


def test_memo_generations_change_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO_ENTRIES", 3)
    assert same(vocabulary, reference, "unheard wordles unheard strangelings of unheard wordles " * 5)


def test_offset_table_with_gaps():
    table = word_bpe.OffsetTable({0: b"ab", 3: b"", 5: b"xyz"})
    assert table.decode([5, 0, 3, 1, 0]) == b"xyzabab" and table.decode([]) == b""
    assert word_bpe.OffsetTable({}).decode([]) == b""


def test_long_texts_decode_in_pieces(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(word_bpe, "DECODED_IDS", 7)
    for n in (0, 1, 6, 7, 8, 21):
        assert same(vocabulary, reference, "word " * n)


@pytest.mark.parametrize("change", [{"decoder": {"type": "ByteLevel"}}, {"normalizer": None}])
def test_unsupported_files_are_refused(change):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        stated = json.load(file)
    with pytest.raises(ValueError):
        word_bpe.WordVocabulary(json.dumps(stated | change))


def test_operator_over_a_table(spark, reference):
    texts = [None, "", "Hello world", "Hello world", "ÄÖÜ ß " * 9_000, " \n "]
    rows = [(i if i != 3 else None, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in word_bpe.digests(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in word_bpe.decode(word_bpe.encode(docs)).collect()}
    for i, t, _ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and back[i] == decoded
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert word_bpe.digests(docs.limit(0)).count() == 0
