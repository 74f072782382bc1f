"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one: a minimal perfect hash over the vocabulary answers for a whole
pre-token in one probe and one comparison. Tier two, for the others: the bytes
form a linked list, a heap holds the mergeable neighbours by rank (lowest rank,
then leftmost), and merged pairs push their new neighbours.

Work per text is independent, so there is no shuffle: Spark hands Arrow batches
to ``encode_batches``. The vocabulary has a fixed size (some 50,000 entries,
about 1 MB) and is broadcast. A bounded memo keeps the ids of recent pre-tokens.

Defined results: a null or empty text has no tokens; decoding gives back the
bytes of the text. Rows are independent, so repeated ids, null ids and further
columns change nothing. An unpaired surrogate cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

MEMO_ENTRIES = 250_000  # pre-tokens in each of the two generations that a worker remembers


class PerfectHash:
    """Minimal perfect hash of byte strings: one seed per bucket, one slot per key."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.size = max(len(keys), 1)
        self.buckets = max(len(keys) // 3, 1)
        groups: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            groups.setdefault(xxhash.xxh64_intdigest(key) % self.buckets, []).append(i)
        self.seeds = [0] * self.buckets  # of the second hash; below zero: the slot itself
        slots: list[int] = [-1] * self.size
        free = None
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                free = free or [p for p in range(self.size) if slots[p] < 0]
                place = free.pop()
                self.seeds[bucket], slots[place] = -1 - place, members[0]
                continue
            seed = 1
            while True:
                places = [xxhash.xxh64_intdigest(keys[i], seed) % self.size for i in members]
                if len(set(places)) == len(places) and all(slots[p] < 0 for p in places):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for i, p in zip(members, places, strict=True):
                slots[p] = i
        self.keys = [keys[i] if i >= 0 else b"" for i in slots]
        self.values = [values[i] if i >= 0 else -1 for i in slots]

    def get(self, key: bytes) -> int:
        """The key's value, -1 for a key that is not in the table."""
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.buckets]
        place = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.size
        return self.values[place] if self.keys[place] == key else -1


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of a token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


@dataclass(frozen=True)
class Shared:
    """A broadcast vocabulary file with its pattern, and a key that names both."""

    key: str
    broadcast: Broadcast


@dataclass
class Vocabulary:
    """What a task needs to encode and decode; the size is that of the vocabulary file."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self):
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.splitter = regex.compile(self.pattern)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is not in the vocabulary: lowest rank first, leftmost first."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end of the part that starts here
        before = list(range(-1, n - 1))  # start of the part before
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, stop = heapq.heappop(heap)
            if not alive[left]:
                continue
            right = end[left]
            if right >= n or end[right] != stop:
                continue  # one of the two has grown meanwhile
            alive[right] = False
            end[left] = stop
            if stop < n:
                before[stop] = left
                if (r := ranks.get(piece[left : end[stop]])) is not None:
                    heapq.heappush(heap, (r, left, end[stop]))
            if (p := before[left]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token that the younger memo does not hold."""
        found = self.older.get(token)
        if found is None:
            raw = token.encode()
            whole = self.whole.get(raw)
            found = (whole,) if whole >= 0 else tuple(self.merged(raw))
        if len(token) <= 64:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo, self.older = {}, self.memo
            self.memo[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        extend, piece = out.extend, self.piece
        for token in self.splitter.findall(text):
            extend(self.memo.get(token) or piece(token))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(shared: Shared) -> Vocabulary:
    """One vocabulary per worker process, kept over its tasks."""
    if shared.key not in _loaded:
        _loaded.clear()
        content, pattern = shared.broadcast.value
        _loaded[shared.key] = Vocabulary(read_ranks(content), pattern)
    return _loaded[shared.key]


def default_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _share(spark: SparkSession, path: str | None, pattern: str | None) -> Shared:
    default_path, default_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    pattern = pattern or default_pattern
    with open(path or default_path, "rb") as file:
        content = file.read()
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    return Shared(key, spark.sparkContext.broadcast((content, pattern)))


def encode(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id, ids array<int>`` per row: the token ids of the whole text."""
    shared = _share(docs.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in it:
            ids = pa.array([vocabulary.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>")


def decode(rows: DataFrame, id_column: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id, bytes binary`` per row of ``encode``'s output."""
    shared = _share(rows.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in it:
            out = pa.array([vocabulary.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_column, "bytes"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, ids).mapInArrow(batches, f"`{id_column}` {kind}, bytes binary")


def digests(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass, keeping digests only.

    A task holds the ids of one text at a time.
    """
    shared = _share(docs.sparkSession, path, pattern)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        decimal = vocabulary.decimal.__getitem__
        for batch in it:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                ids = vocabulary.encode(value.as_py() or "")
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        batches, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
