"""Alignment of the tokens of two tokenizers over the bytes of the same texts.

Tokenizer A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model.
A's character offsets and B's byte spans give coarse cuts; inside a character that several
tokens share (parts of a multibyte character, byte-fallback pieces) the decoded bytes of
the tokens refine them. Two tokens are linked where their byte ranges overlap, and places
where tokens of both end cut the text into groups.

Neither tokenizer merges across the start of a run of white space or from a letter to a
digit or mark, save for characters that the model's pieces join to what is before them,
which are found when it is loaded. So a text is cut into chunks there, and a bounded memo
of each worker keeps the aligned chunks.

``align`` gives the groups, ``link_counts`` how many documents hold a linked pair of ids,
and ``link_report`` scores every document's links by those counts: the first pass writes
each document's distinct pairs, Spark counts them with partial sums before the shuffle,
and the second pass scores. Counts of the most frequent pairs, at most ``HEAD_PAIRS``, are
broadcast; all rarer pairs are joined by shuffle, and none of those is a hot key.

Defined results: a text that is null, empty or not reproduced by the joined bytes of both
tokenizers has no tokens, no groups and no links. Special tokens' strings are plain text.
Rows are independent documents, whatever their ids: rows with equal or null ids count each.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from growthlens.llm.common import written
from growthlens.llm.word_bpe import WHITE_SPACE, byte_letters

MEMO_CHUNKS = 400_000  # chunks in each of the two generations that a worker remembers
MEMO_LENGTH = 64  # characters of the longest chunk that is remembered
HEAD_PAIRS = 1_000_000  # most pairs of ids whose counts are broadcast, 17 bytes each

JOINED = 100_000  # characters of the text in which chunks go to the tokenizers together

SPACE = "▁"


class Chunk(NamedTuple):
    """Aligned tokens of one piece of text."""

    n_a: int
    n_b: int
    n_groups: int
    links: array  # 64-bit numbers: A's id times the size of B's vocabulary plus B's id, one per overlap
    groups: str  # "a1,a2|b1;a3|b2"


def byte_ends(starts: np.ndarray, ends: np.ndarray, byte_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes, from spans whose ends stand at bytes ``byte_at``.

    A span that ends where the next one starts is a cut between characters. Spans that are
    empty or overlap the next one lie inside a character: from the last cut on, the
    tokens' own bytes count.
    """
    following = np.append(starts[1:], ends[-1:])
    cut = (starts < ends) & (ends <= following)
    run = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))
    return np.where(last < 0, run, byte_at[ends[last]] + run - run[last])


class Aligner:
    """Both tokenizers, as a task uses them."""

    def __init__(self, content_a: str, content_b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(content_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=content_b)
        byte_of = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.names = list(map(str, range(max(self.width, len(self.bytes_a)))))
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.chunks = self._chunk_pattern(
            [p for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_byte(i) and not self.b.is_unknown(i)]
        )
        self.memo: dict[str, Chunk | None] = {}
        self.older: dict[str, Chunk | None] = {}

    def _chunk_pattern(self, pieces: list[str]) -> re.Pattern:
        """Cuts a text where both tokenizers surely have a border: before a run of white space, and between
        a letter that A knows as one and an ASCII digit or mark, unless one of B's pieces holds the two sides."""
        letters = [c for c in map(chr, range(0x41, 0x530)) if len(self.a.pre_tokenizer.pre_tokenize_str(f"x{c}")) == 1]
        white = re.compile(f"[{WHITE_SPACE}]")
        behind = {y for p in pieces for x, y in itertools.pairwise(p) if (x, y) != (SPACE, SPACE)}
        if SPACE in behind:
            raise ValueError("the model's pieces reach across spaces")
        known = set(letters)
        beside = {y for p in pieces for x, y in itertools.pairwise(p) if x in known}
        marks = "".join(re.escape(c) for c in map(chr, range(0x21, 0x7F)) if c not in known and c not in beside)
        letter, joined = re.escape("".join(letters)), re.escape("".join(sorted(c for c in behind if white.match(c))))
        rest = f"[^{WHITE_SPACE}{letter}]*+"
        body = f"{rest}(?:[{letter}]++[^{WHITE_SPACE}{letter}{marks}]{rest})*+[{letter}]*+"
        more = f"(?:[{joined}][{WHITE_SPACE}]*+{body})*+" if joined else ""
        return re.compile(f"(?=.)[{WHITE_SPACE}]*+{body}{more}", re.DOTALL)

    def _tokens(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids and byte ends of both tokenizers for a text that starts with a space; None if one does not reproduce it."""
        raw = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        ids_a = found.ids
        pieces = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)  # the model adds the space
        ids_b = pieces["ids"]
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        spans, spans_b = (
            np.fromiter(itertools.chain.from_iterable(x), np.int64, 2 * len(x)).reshape(-1, 2) for x in (found.offsets, pieces["offsets"])
        )
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        if len(raw) == len(text):
            byte_at = np.arange(len(raw) + 1)
        else:  # where each character starts
            octets = np.frombuffer(raw, np.uint8)
            byte_at = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(raw))
        ends_a = byte_ends(spans[:, 0], spans[:, 1], byte_at, self.lengths_a[ids_a])
        starts, stops = spans_b[:, 0] + 1, spans_b[:, 1] + 1
        starts[:1] = 0
        ends_b = byte_ends(starts, stops, np.arange(len(raw) + 1), self.lengths_b[ids_b])
        return ids_a, ends_a, ids_b, ends_b

    def _aligned(self, text: str, ranges: list[tuple[int, int]]) -> list[Chunk] | None:
        """Aligned chunks of a text, given by byte ranges between common borders."""
        tokens = self._tokens(text)
        if tokens is None:
            return None
        ids_a, ends_a, ids_b, ends_b = tokens
        # Between neighbouring cuts of either tokenizer lies one token of each: one link.
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        links = (ids_a[at_a] * self.width + ids_b[at_b]).tobytes()
        common = np.flatnonzero((ends_a[at_a] == cuts) & (ends_b[at_b] == cuts))
        after_a, after_b = (at_a[common] + 1).tolist(), (at_b[common] + 1).tolist()
        borders = cuts[common]
        froms, tos = (np.array(x, np.int64) for x in zip(*ranges, strict=True))
        first, last = np.searchsorted(borders, froms), np.searchsorted(borders, tos)  # the border at each side
        link_from, link_to = np.searchsorted(cuts, froms, "right").tolist(), np.searchsorted(cuts, tos, "right").tolist()
        text_a, text_b = (list(map(self.names.__getitem__, x.tolist())) for x in (ids_a, ids_b))
        groups, a, b = [], 0, 0
        for next_a, next_b in zip(after_a, after_b, strict=True):  # most groups are one token of each
            one = text_a[a] if next_a - a == 1 else ",".join(text_a[a:next_a])
            other = text_b[b] if next_b - b == 1 else ",".join(text_b[b:next_b])
            groups.append(f"{one}|{other}")
            a, b = next_a, next_b
        after_a.append(0)  # in front of the first border, which place -1 stands for
        after_b.append(0)
        out = []
        for start, k, k_end, l, l_end in zip(froms.tolist(), first.tolist(), last.tolist(), link_from, link_to, strict=True):
            k = k if start else -1
            own = array("q", links[8 * l : 8 * l_end])
            text = groups[k_end] if k_end - k == 1 else ";".join(groups[k + 1 : k_end + 1])
            out.append(Chunk(after_a[k_end] - after_a[k], after_b[k_end] - after_b[k], k_end - k, own, text))
        return out

    def _align(self, chunks: list[str]) -> Iterator[tuple[str, Chunk | None]]:
        """Chunks with their alignment, None for one that a tokenizer does not reproduce.

        Many chunks go to the tokenizers as one text, each behind " a", which makes its start a border.
        A chunk that ends in white space would join that, and goes alone.
        """
        runs: list[list[str]] = [[]]
        held = 0
        for chunk in chunks:
            if chunk[-1:].isspace() or len(chunk) > JOINED:
                runs.insert(0, [chunk])
                continue
            if held > JOINED:
                runs.append([])
                held = 0
            runs[-1].append(chunk)
            held += len(chunk) + 2
        for run in filter(None, runs):
            ranges, place = [], 0
            for chunk in run:
                size = len(chunk) if chunk.isascii() else len(chunk.encode())
                ranges.append((place + 2, place + 2 + size))
                place += 2 + size
            found = self._aligned("".join(f" a{c}" for c in run), ranges)
            if found is None and len(run) > 1:
                for chunk in run:
                    one = self._aligned(f" a{chunk}", [(2, 2 + len(chunk.encode()))])
                    yield chunk, one and one[0]
            else:
                yield from zip(run, found or [None], strict=True)

    def known(self, texts: list[list[str]]) -> dict[str, Chunk | None]:
        """The aligned chunks of some texts: those that are not remembered go to the tokenizers together."""
        wanted = set().union(*texts)
        found = {c: self.memo[c] for c in wanted if c in self.memo}
        others = wanted - found.keys()
        late = {c: self.older[c] for c in others if c in self.older}
        late.update(self._align(sorted(others - late.keys())))
        if len(self.memo) >= MEMO_CHUNKS:
            self.memo, self.older = {}, self.memo
        self.memo.update((c, x) for c, x in late.items() if len(c) <= MEMO_LENGTH)
        return found | late

    def cut(self, text: str | None) -> list[str]:
        """Chunks of a text with the space before it. None where the text holds the model's own letter for
        a space, which never comes back as itself."""
        return self.chunks.findall(f" {text}") if text and SPACE not in text else []

    def texts(self, texts: list[str | None]) -> Iterator[list[Chunk]]:
        """The aligned chunks of each text, none for a text without tokens."""
        cut = list(map(self.cut, texts))
        known = self.known(cut)
        lost = {c for c, x in known.items() if x is None}
        for chunks in cut:
            yield [] if lost and not lost.isdisjoint(chunks) else list(map(known.__getitem__, chunks))


@dataclass(frozen=True)
class Pair:
    """Broadcast vocabulary files of both tokenizers and their digest."""

    key: str
    broadcast: Broadcast


_loaded: dict[str, Aligner] = {}


def _aligner(pair: Pair) -> Aligner:
    """One aligner per worker process, kept over its tasks."""
    if pair.key not in _loaded:
        _loaded.clear()
        _loaded[pair.key] = Aligner(*pair.broadcast.value)
    return _loaded[pair.key]


def _share(spark: SparkSession, path_a: str | None, path_b: str | None) -> Pair:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
        path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        contents = (a.read(), b.read())
    digest = hashlib.sha256(contents[0].encode() + contents[1]).hexdigest()
    return Pair(digest, spark.sparkContext.broadcast(contents))


def _some(batch: pa.RecordBatch, characters: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of a batch's texts of some bounded total length, with the place of the first."""
    start, held, texts = 0, 0, []
    for i, value in enumerate(batch.column(1)):
        text = value.as_py()
        texts.append(text)
        held += len(text or "")
        if held >= characters:
            yield start, texts
            start, held, texts = i + 1, 0, []
    if texts:
        yield start, texts


def align(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``id, groups`` per row: the groups as text, ``a1,a2|b1;a3|b2``, decimal ids of A and B in order."""
    pair = _share(docs.sparkSession, path_a, path_b)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(pair)
        for batch in it:
            for start, texts in _some(batch):
                groups = pa.array([";".join(c.groups for c in chunks) for chunks in aligner.texts(texts)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), groups], names=[id_column, "groups"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(batches, f"`{id_column}` {kind}, groups string")


def aligned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Written table of one row per document: a ``row`` number, the id, counts, the digest of the groups,
    and the distinct linked pairs (``links``, ascending codes) with how often each occurs (``times``)."""
    pair = _share(docs.sparkSession, path_a, path_b)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(pair)
        row = TaskContext.get().partitionId() << 33
        for batch in it:
            for start, texts in _some(batch):
                counts, digests, links, times = [], [], [], []
                for chunks in aligner.texts(texts):
                    *numbers, listed, groups = zip(*chunks, strict=True) if chunks else ((),) * 5
                    codes = np.frombuffer(b"".join(listed), np.int64)
                    counts.append((*map(sum, numbers), len(codes)))
                    digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if chunks else "")
                    distinct, often = np.unique(codes, return_counts=True)
                    links.append(distinct)
                    times.append(often.astype(np.int32))
                n = len(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype(np.int32)
                numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n), pa.int64()),
                        batch.column(0).slice(start, n),
                        *numbers,
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(ends, np.concatenate(links)),
                        pa.ListArray.from_arrays(ends, np.concatenate(times)),
                    ],
                    names=["row", id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"],
                )
                row += n

    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"row long, `{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, links array<long>, times array<int>"
    )
    return written(docs.select(id_column, text).mapInArrow(batches, schema), "aligned")


def link_counts(rows: DataFrame, width: int) -> DataFrame:
    """``link, n, best``: in how many rows of ``aligned`` a pair is linked, and whether no pair of its A id is in more."""
    counted = written(rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")), "link_counts")
    first = F.floor(F.col("link") / width).cast("int")
    most = counted.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row per id of A's vocabulary
    joined = counted.withColumn("a", first).join(F.broadcast(most), "a")
    return joined.select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counts: DataFrame, at_most: int) -> int:
    """The least power of two that at most ``at_most`` pairs reach with their count."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    held, least = 0, 63
    for power, pairs in sizes:
        held += pairs
        if held > at_most:
            break
        least = power
    return 1 << min(least, 62)


def link_report(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    pair = _share(spark, path_a, path_b)
    width = SentencePieceProcessor(model_proto=pair.broadcast.value[1]).get_piece_size()
    rows = aligned(docs, id_column, text, path_a, path_b)
    counts = written(link_counts(rows, width), "links")
    least = _head(counts, head_pairs)
    head = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(head["link"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(head[c].to_numpy()[order] for c in ("link", "n", "best")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, often, best = known.value
        for batch in it:
            listed = batch.column(1)
            ends = listed.offsets.to_numpy()
            codes = listed.values.to_numpy()[ends[0] : ends[-1]]
            times = batch.column(2).values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            ends = ends - ends[0]
            place = np.minimum(np.searchsorted(links, codes), max(len(links) - 1, 0))
            found = links[place] == codes if len(links) else np.zeros(len(codes), bool)
            place = place[found]
            sums, bests, missed = (np.zeros(len(codes), np.int64) for _ in range(3))
            sums[found] = often[place] * times[found]
            bests[found] = best[place] * times[found]
            missed[~found] = 1
            total = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (bests, sums, missed)]
            rest = np.concatenate([[0], np.cumsum(total[2])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total[0], pa.int64()),
                    pa.array(total[1], pa.int64()),
                    pa.ListArray.from_arrays(rest, codes[~found]),
                    pa.ListArray.from_arrays(rest, times[~found]),
                ],
                names=["row", "n_best", "count_sum", "links", "times"],
            )

    schema = "row long, n_best long, count_sum long, links array<long>, times array<long>"
    scored = written(rows.select("row", "links", "times").mapInArrow(batches, schema), "link_scores")
    rare = scored.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", "x.links", "x.times")
    rare = rare.withColumnRenamed("links", "link").join(counts.filter(F.col("n") < least).hint("merge"), "link")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums = scored.select("row", "n_best", "count_sum").unionByName(rare)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = [id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.drop("links", "times").join(sums, "row").select(*columns)
