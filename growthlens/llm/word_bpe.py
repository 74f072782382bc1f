"""BPE with listed merges: a backtracking encoder in linear time, and decoding by an offset table.

A vocabulary file of the tokenizers library lists merges in the order of their ranks. For
one pre-token the encoder takes the longest vocabulary entry at its place (Aho-Corasick
over all entries, once per pre-token) and keeps it if the pair with the entry before it is
compatible: no merge that comes earlier would have crossed their border. Otherwise it
tries the next shorter entry, and steps back when none is left; a place that once failed
is never tried again, so the work is linear in the length. The result is that of merging
by rank. Ids are turned into text by one table of all contents with their offsets.

White space, case, canonical composition and the cut into pre-tokens follow the file. Texts
with characters that Python's Unicode tables and the library's do not treat alike go
through the library's normaliser and pre-tokenizer objects.

Work per text is independent, so nothing is shuffled; the vocabulary file has a fixed size
(under 2 MB) and is broadcast. A bounded memo keeps the ids of recent pre-tokens.

Defined results: a null or empty text has no tokens and decodes to empty text; a special
token's string inside a text is that token, as the library has it; rows are independent,
so repeated or null ids and further columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

MEMO_ENTRIES = 200_000  # pre-tokens in each of the two generations that a worker remembers
MEMO_LENGTH = 64  # characters of the longest pre-token that is remembered
DECODED_IDS = 65_536  # ids that are turned into text at once

#: The characters with Unicode's White_Space property.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Familiar:
    """Knows the characters that Python's Unicode tables and a normaliser of the library treat alike.

    A character that is not assigned in Python's tables, orders differently among combining
    marks or takes part in a composition that only one side knows is not familiar.
    """

    def __init__(self, normalizer):
        self.normalizer = normalizer
        self.good: set[str] = set()
        self.odd: set[str] = set()
        for c in map(chr, range(0xC0, 0x30000)):
            if (parts := unicodedata.decomposition(c)) and parts[0] != "<" and not self._alike(unicodedata.normalize("NFD", c)):
                self.odd |= set(unicodedata.normalize("NFD", c))

    def _alike(self, text: str) -> bool:
        return self.normalizer.normalize_str(text) == unicodedata.normalize("NFC", text).lower()

    def _check(self, c: str) -> bool:
        if unicodedata.category(c) == "Cn" or c in self.odd:
            return False
        if c.isspace():
            return True  # separates, whatever the library turns it into
        probes = [f"x{c}x"]
        if unicodedata.combining(c):
            probes += [f"x\u0345{c}", f"x{c}\u0334"]  # the marks that go last and first
        return all(map(self._alike, probes))

    def all_of(self, text: str) -> bool:
        fresh = set(text) - self.good
        if fresh:
            self.good |= {c for c in fresh if self._check(c)}
            return fresh <= self.good
        return True


class Merges:
    """Exact BPE over one alphabet by backtracking.

    Entries are numbered so that a merge's number exceeds those of its parts and grows with
    its rank: first the alphabet, then the merges in their order. A word is a string of
    alphabet symbols.
    """

    def __init__(self, alphabet: list[str], merges: list[tuple[int, int]]):
        self.first_merge = len(alphabet)
        self.size = len(alphabet) + len(merges)
        self.left, self.right = list(range(len(alphabet))), list(range(len(alphabet)))
        self.symbols = list(alphabet)
        self.pairs: dict[int, int] = {}
        for number, (a, b) in enumerate(merges, len(alphabet)):
            if max(a, b) >= number:
                raise ValueError("a merge uses an entry that a later merge makes")
            self.left.append(a)
            self.right.append(b)
            self.symbols.append(self.symbols[a] + self.symbols[b])
            self.pairs.setdefault(a * self.size + b, number)
        # An entry that its own symbols do not lead to occurs in no result.
        reached = [True] * self.size
        for n in range(self.first_merge, self.size):
            a, b = self.left[n], self.right[n]
            reached[n] = reached[a] and reached[b] and self.pairs[a * self.size + b] == n and self.border_holds(a, b, n)
        number_of = {s: n for n, s in enumerate(self.symbols) if reached[n]}
        self.shorter = array("i", [-1]) * self.size
        self.matches = ahocorasick.Automaton()
        for s, n in number_of.items():
            self.matches.add_word(s[::-1], n)
            for stop in range(len(s) - 1, 0, -1):
                if (prefix := number_of.get(s[:stop])) is not None:
                    self.shorter[n] = prefix
                    break
        self.matches.make_automaton()

    def border_holds(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether merging leaves the border between ``a`` and ``b``, which touch there.

        The merges that made the two are undone from the latest back. The border falls if the
        parts that touch it have a merge with a number below the one undone last. Of equal
        merges the left one comes first, so the border wins against an equal merge on its right.
        """
        limit = self.size if before is None else before
        pairs, size = self.pairs, self.size
        while True:
            across = pairs.get(a * size + b)
            if across is not None and across < limit:
                return False
            if a > b:
                if a < self.first_merge:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < self.first_merge:
                    return True
                limit, b = b + 1, self.left[b]

    def longest(self, word: str) -> list[int]:
        """The longest entry that starts at each place; matches of the reversed word end there."""
        out = [-1] * len(word)
        last = len(word) - 1
        for end, number in self.matches.iter(word[::-1]):
            if out[last - end] < 0:  # longer matches of one end come first
                out[last - end] = number
        return out

    def encode(self, word: str) -> list[int]:
        starts = self.longest(word)
        if -1 in starts:
            raise ValueError("a symbol is not in the alphabet")
        end, symbols, shorter, holds = len(word), self.symbols, self.shorter, self.border_holds
        possible = bytearray(b"\x01") * (end + 1)  # places that have not failed yet
        out: list[int] = []
        place, entry = 0, starts[0] if end else -1
        while place < end:
            stop = place + len(symbols[entry])
            if possible[stop] and (not out or holds(out[-1], entry)):
                out.append(entry)
                place = stop
                if place < end:
                    entry = starts[place]
            elif shorter[entry] >= 0:
                entry = shorter[entry]
            else:
                # Nothing fits behind the last entry: its end cannot be a border.
                possible[place] = 0
                entry = out.pop()
                place -= len(symbols[entry])
        return out


class OffsetTable:
    """Contents of all ids in one block of bytes with the offset of each; ids without one are empty."""

    def __init__(self, contents: dict[int, bytes]):
        size = max(contents, default=-1) + 1
        parts = [contents.get(i, b"") for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        self.block = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        shift = starts - (np.cumsum(lengths) - lengths)
        return self.block[np.arange(lengths.sum()) + np.repeat(shift, lengths)].tobytes()


def read_merges(model: dict) -> tuple[Merges, list[int], str]:
    """Merges over bytes, the ids of their entries, and the suffix that marks the end of a word.

    Symbol ``chr(b)`` is byte ``b``; ``chr(256 + b)`` is byte ``b`` at the end of a word, in vocabularies that tell them apart.
    """
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("not a plain BPE vocabulary")
    if model.get("continuing_subword_prefix"):
        raise ValueError("a prefix of continuing parts is not supported")
    suffix, vocabulary, letters = model.get("end_of_word_suffix") or "", model["vocab"], byte_letters()
    alphabet = [(letter, chr(byte)) for letter, byte in letters.items()]
    if suffix:
        alphabet += [(letter + suffix, chr(256 + byte)) for letter, byte in letters.items()]
    missing = [content for content, _ in alphabet if content not in vocabulary]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} bytes")
    number = {content: n for n, (content, _) in enumerate(alphabet)}
    merges = []
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a + b in number:
            raise ValueError(f"two merges make {a + b!r}")
        merges.append((number[a], number[b]))
        number[a + b] = len(number)
    return Merges([s for _, s in alphabet], merges), [vocabulary[content] for content in number], suffix


@dataclass
class WordVocabulary:
    """A vocabulary file of the tokenizers library, as a task uses it."""

    content: str

    def __post_init__(self):
        from tokenizers import Tokenizer

        stated = json.loads(self.content)
        if stated.get("post_processor") or stated.get("decoder"):
            raise ValueError("a post-processor or decoder is not supported")
        self.merges, self.ids, self.suffix = read_merges(stated["model"])
        library = Tokenizer.from_str(self.content)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.pattern = self._own_pattern(stated)
        self.familiar = Familiar(self.normalizer)
        added = stated.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(map(regex.escape, by_length))})") if by_length else None
        contents = {i: c for c, i in stated["model"]["vocab"].items()} | {i: c for c, i in self.added.items()}
        # Without a decoder the library puts a space between the contents.
        self.table = OffsetTable({i: f"{c} ".encode() for i, c in contents.items()})
        self.decimal = [str(i) for i in range(max(contents) + 1)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _own_pattern(stated: dict) -> regex.Pattern:
        """The file's pre-token pattern, for texts that ``words`` brings into normal form itself."""
        match stated:
            case {
                "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "content": " "} as spaces, {"type": "Lowercase"}]},
                "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "behavior": "Removed", "invert": True} as split, {"type": "ByteLevel"} as level]},
            } if spaces["pattern"] == {"Regex": r"\s+"} and not level["add_prefix_space"] and not level["use_regex"]:
                return regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE_SPACE))
        raise ValueError("this normaliser and pre-tokenizer are not supported")

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens, as plain text."""
        if not self.familiar.all_of(text):
            letters = byte_letters()
            found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(map(letters.__getitem__, word)).decode() for word, _ in found]
        # Every capital sigma becomes the same small one, also at the end of a word. White space
        # only separates pre-tokens, so it need not be replaced.
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token that the younger memo does not hold."""
        found = self.older.get(word)
        if found is None:
            symbols = word.encode().decode("latin-1")
            if self.suffix:
                symbols = symbols[:-1] + chr(256 + ord(symbols[-1]))
            found = tuple([self.ids[n] for n in self.merges.encode(symbols)])
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            self.memo[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        extend, one, memo = out.extend, self.word, self.memo
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                out.append(self.added[part])
                continue
            for word in self.words(part):
                extend(memo.get(word) or one(word))
                memo = self.memo
        return out

    def decoded(self, ids: list[int]) -> Iterator[bytes]:
        """The UTF-8 bytes of the decoded text in pieces."""
        for start in range(0, len(ids), DECODED_IDS):
            piece = self.table.decode(ids[start : start + DECODED_IDS])
            yield piece if start + DECODED_IDS < len(ids) else piece[:-1]


@dataclass(frozen=True)
class SharedFile:
    """A broadcast vocabulary file and its digest."""

    key: str
    broadcast: Broadcast


_loaded: dict[str, WordVocabulary] = {}


def _vocabulary(shared: SharedFile) -> WordVocabulary:
    """One vocabulary per worker process, kept over its tasks."""
    if shared.key not in _loaded:
        _loaded.clear()
        _loaded[shared.key] = WordVocabulary(shared.broadcast.value)
    return _loaded[shared.key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _share(spark: SparkSession, path: str | None) -> SharedFile:
    with open(path or default_path(), encoding="utf-8") as file:
        content = file.read()
    return SharedFile(hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content))


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id, ids array<int>`` per row: the token ids of the whole text."""
    shared = _share(docs.sparkSession, path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in it:
            ids = pa.array([vocabulary.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>")


def decode(rows: DataFrame, id_column: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``id, text`` per row of ``encode``'s output, special tokens included; null ids decode to empty text."""
    shared = _share(rows.sparkSession, path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in it:
            out = [b"".join(vocabulary.decoded(x.as_py() or [])).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_column, "text"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, ids).mapInArrow(batches, f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, keeping digests only.

    A task holds the ids of one text at a time.
    """
    shared = _share(docs.sparkSession, path)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        decimal = vocabulary.decimal.__getitem__
        for batch in it:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                ids = vocabulary.encode(value.as_py() or "")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for piece in vocabulary.decoded(ids):
                    digest.update(piece)
                decoded.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        batches, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
