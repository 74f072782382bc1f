"""Token alignment against whole texts through both libraries and all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from growthlens.llm import align

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def aligner():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        return align.Aligner(a.read(), b.read())


def brute(aligner, text):
    """Ids of the whole text, links of all pairs whose ranges overlap, and groups; None without tokens."""
    if not text:
        return None
    ids = aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [aligner.bytes_a[i] for i in ids[0]], [aligner.bytes_b[i] for i in ids[1]]
    if any(b"".join(p) != f" {text}".encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]) for p in parts]
    starts = [e - [len(x) for x in p] for e, p in zip(ends, parts)]
    over = np.maximum.outer(starts[0], -starts[1] * 0) < ends[1][None, :]
    over &= starts[1][None, :] < ends[0][:, None]
    links = [(ids[0][i], ids[1][j]) for i, j in np.argwhere(over)]
    groups, lower = [], 0
    for cut in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
        sides = [",".join(str(x) for x, e in zip(i, en) if lower < e <= cut) for i, en in zip(ids, ends)]
        groups.append("|".join(sides))
        lower = cut
    return len(ids[0]), len(ids[1]), links, ";".join(groups)


def mine(aligner, text):
    chunks = next(iter(aligner.texts([text])))
    if not chunks:
        return None
    links = [divmod(x, aligner.width) for c in chunks for x in c.links]
    return sum(c.n_a for c in chunks), sum(c.n_b for c in chunks), sorted(links), ";".join(c.groups for c in chunks)


def equal(aligner, text):
    want = brute(aligner, text)
    return mine(aligner, text) == (want and (want[0], want[1], sorted(want[2]), want[3]))


POOL = [*"aBz é ß \x1c\x1f\x85\x0b\x0c\t\n\r 　 '’s12½Ⅷ三あ😀🏽‍́_-Σς\xa0.,;)", "'ll", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "𐍈", "  ", "();\r"]


def test_random_texts(aligner):
    rng = random.Random(1)
    pieces = [aligner.b.id_to_piece(i).replace("▁", " ") for i in range(300, aligner.width)]
    for k in range(3_000):
        text = "".join(rng.choice(POOL) if rng.random() < 0.6 else rng.choice(pieces) for _ in range(rng.randint(0, 20)))
        assert equal(aligner, text + ("▁" if k % 50 == 0 else "")), text


def test_very_long_runs(aligner):
    for text in ("a" * 3_000, " " * 3_000, "é" * 900, "\n" * 900, "😀" * 600, "a1" * 900, "x\r\n y" * 400):
        assert equal(aligner, text), text[:5]


def test_chunks_together_and_alone_agree(aligner, monkeypatch):
    texts = ["one two, three.", "one Σ two", "äöü (x) 12", " trailing "]
    together = [mine(aligner, t) for t in texts]
    monkeypatch.setattr(align, "JOINED", 1)
    monkeypatch.setattr(align, "MEMO_CHUNKS", 1)
    aligner.memo, aligner.older = {}, {}
    assert [mine(aligner, t) for t in texts] == together


def test_spans_inside_a_character_go_by_decoded_bytes():
    # "x", a character of four bytes in three tokens with overlapping or empty spans, "y"
    byte_at = np.array([0, 1, 5, 6])
    lengths = np.array([1, 1, 2, 1, 1])
    overlapping = align.byte_ends(np.array([0, 1, 1, 1, 2]), np.array([1, 2, 2, 2, 3]), byte_at, lengths)
    empty = align.byte_ends(np.array([0, 1, 1, 1, 2]), np.array([1, 1, 1, 2, 3]), byte_at, lengths)
    assert overlapping.tolist() == empty.tolist() == [1, 2, 4, 5, 6]


def expected(aligner, texts):
    found = [brute(aligner, t) for t in texts]
    counts = Counter(x for f in found if f for x in set(f[2]))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = f
        best = sum(counts[x] == most[x[0]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        out.append((n_a, n_b, groups.count(";") + 1, len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out)


@pytest.mark.parametrize("head", [0, 40, 1_000_000])
def test_report_over_a_table(spark, aligner, head):
    rng = random.Random(2)
    words = ["the", "of", "Übergröße", "naïve", "三あ", "😀", "x-y", "1,234", "zqx", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [None, "", "   ", "a▁b", texts[0], texts[0], "q" * 5_000]
    rows = [(i if i % 7 else 3, t, "extra", i) for i, t in enumerate(texts)] + [(None, texts[1], "extra", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, row int")
    got = align.link_report(docs, head_pairs=head).collect()
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == expected(aligner, [r[1] for r in rows])
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_groups_and_an_empty_table(spark, aligner):
    docs = spark.createDataFrame([(1, "Hello 世界 x"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in align.align(docs).collect()}
    assert got == {1: brute(aligner, "Hello 世界 x")[3], 2: ""}
    assert align.link_report(docs.limit(0)).count() == 0


def test_links_are_packed_and_offsets_come_without_a_message_per_token(aligner, monkeypatch):
    asked, encode = [], aligner.b.encode
    monkeypatch.setattr(aligner.b, "encode", lambda text, **options: asked.append(options["return_type"]) or encode(text, **options), raising=False)
    aligner.memo, aligner.older = {}, {}
    chunks = next(iter(aligner.texts(["Übung 😀𐍈 two  words"])))
    assert asked and set(asked) == {"offset_mapping"}
    assert all(memoryview(c.links).itemsize == 8 for c in chunks)
