"""Byte-level BPE encoding and decoding with a two-tier look-up.

A pattern cuts texts into pre-tokens. The first tier is a minimal perfect hash over the vocabulary: a
pre-token that is a token as it stands is resolved by one slot and one comparison of bytes. The hash is
built by displacement: keys fall into buckets, a bucket of several keys gets the first displacement that
sends all of them to free slots, a bucket of one key names its slot. The second tier takes the misses: the
bytes of a pre-token form a linked list, a heap holds its neighbouring pairs by rank and place, and the
lowest rank joins until no pair is a token. Ranks of pairs come from the same hash, those of two bytes from
a table. Decoding gathers the tokens' bytes. One pass over the rows, no shuffle; a worker's tables have the
size of the vocabulary, and the pre-tokens that it remembers are bounded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import small_batches

#: Pre-tokens that a worker remembers in each of two generations, and the longest that is remembered.
KEPT, KEPT_CHARS = 250_000, 64
#: Characters whose pre-tokens are taken at once; a longer text is cut before a blank between two words.
SLICE = 1 << 20
#: Displacements that are tried together.
TRIED = 64

_MASK = (1 << 64) - 1
#: Odd multipliers of the hash that follows a displacement.
_SPREAD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CUT = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")


def _slots(hashes: np.ndarray, moved: np.ndarray, n: int) -> np.ndarray:
    """The slots of hashes under displacements."""
    x = hashes ^ (moved.astype(np.uint64) * np.uint64(_SPREAD))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct keys: n keys, n slots. A key that is not among them is told by
    comparison with the key in its slot."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 2)
        hashes = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("two keys are equal, or their 64-bit hashes are")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        size = np.bincount(bucket, minlength=self.buckets)
        order = np.lexsort((bucket, -size[bucket]))
        at = np.full(self.n, -1, np.int64)
        moved = np.zeros(self.buckets, np.int64)
        starts = np.nonzero(np.diff(bucket[order], prepend=-1))[0].tolist()
        alone = next((k for k, s in enumerate(starts) if size[bucket[order[s]]] == 1), len(starts))
        for s in starts[:alone]:
            mine = order[s : s + size[bucket[order[s]]]]
            first = 1
            while True:
                tried = np.arange(first, first + TRIED)
                slots = _slots(hashes[mine][None, :], tried[:, None], self.n)
                good = (at[slots] < 0).all(1)
                sorted_slots = np.sort(slots, 1)
                good &= (np.diff(sorted_slots, axis=1) > 0).all(1)
                if good.any():
                    k = int(good.argmax())
                    moved[bucket[mine[0]]], at[slots[k]] = tried[k], mine
                    break
                first += TRIED
        single = order[np.array(starts[alone:], np.int64)]
        free = np.nonzero(at < 0)[0][: len(single)]
        moved[bucket[single]], at[free] = -1 - free, single
        self.moved, self.at = moved, at
        self.keys: list[bytes | None] = [keys[k] if k >= 0 else None for k in at.tolist()]
        self._moved, self._at = moved.tolist(), at.tolist()

    def find_all(self, words: list[bytes]) -> list[int]:
        """The number of each word among the keys, -1 where it is none."""
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        moved = self.moved[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(moved < 0, -1 - moved, _slots(hashes, moved, self.n))
        keys = self.keys
        return [k if keys[s] == w else -1 for w, s, k in zip(words, slots.tolist(), self.at[slots].tolist())]

    def find(self, word: bytes) -> int:
        h = xxh3_64_intdigest(word)
        d = self._moved[h % self.buckets]
        if d < 0:
            s = -1 - d
        else:
            x = h ^ (d * _SPREAD & _MASK)
            x = (x ^ (x >> 32)) * _MIX & _MASK
            s = (x ^ (x >> 29)) % self.n
        return self._at[s] if self.keys[s] == word else -1


class ByteBpe:
    """A vocabulary of ranks with its pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.hash = PerfectHash(list(ranks))
        self.rank_at = list(ranks.values())  # of the hash's numbers
        size = max(self.rank_at) + 1
        self.pairs = [-1] * 65536
        spelt = [b""] * size
        for token, rank in ranks.items():
            spelt[rank] = token
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.length = np.fromiter(map(len, spelt), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        # white space as the pattern's own library has it: without U+001C to U+001F
        unicode = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pieces = regex.compile(unicode, regex.V0)
        ascii_ = pattern.replace(r"\S", r"[^\t-\r ]").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\s", r"[\t-\r ]")
        ascii_ = ascii_.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii_pieces = re.compile(ascii_) if "\\p" not in ascii_ else None
        self.joined: dict[int, int] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _join(self, pair: int, word: bytes) -> int:
        """The rank of a pair of tokens, remembered."""
        if len(self.joined) >= KEPT:
            self.joined.clear()
        k = self.hash.find(word)
        self.joined[pair] = r = self.rank_at[k] if k >= 0 else -1
        return r

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself. Heap entries are rank << 40 | place; a place holds the
        rank that its pair has now, so that entries of earlier pairs are told."""
        n, pairs, joined = len(word), self.pairs, self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [pairs[a << 8 | b] for a, b in zip(word, word[1:])]
        now.append(-1)
        ids = [self.single[b] for b in word]
        heap = [r << 40 | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            if now[i] != rank:
                continue
            gone = after[i]
            ids[i], now[gone] = rank, -1
            end = after[i] = after[gone]
            if end < n:
                before[end] = i
                r = joined.get(rank << 32 | ids[end])
                if r is None:
                    r = self._join(rank << 32 | ids[end], word[i : after[end]])
                now[i] = r
                if r >= 0:
                    heappush(heap, r << 40 | i)
            else:
                now[i] = -1
            p = before[i]
            if p >= 0:
                r = joined.get(ids[p] << 32 | rank)
                if r is None:
                    r = self._join(ids[p] << 32 | rank, word[p:end])
                now[p] = r
                if r >= 0:
                    heappush(heap, r << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids, as bytes, of pre-tokens."""
        words, rank_at = [w.encode() for w in new], self.rank_at
        out = {}
        for text, word, k in zip(new, words, self.hash.find_all(words)):
            if k >= 0:
                out[text] = rank_at[k].to_bytes(4, "little")
            else:
                out[text] = b"".join([i.to_bytes(4, "little") for i in self.merge(word)])
        return out

    def split(self, text: str) -> list[str]:
        return (self.ascii_pieces if self.ascii_pieces and text.isascii() else self.pieces).findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit integers."""
        split = [self.split(text) for text in texts]
        seen = set().union(*split)
        new = [w for w in seen if w not in self.young]
        found = {w: self.old[w] for w in new if w in self.old}
        found |= self._learn([w for w in new if w not in found])
        if len(self.young) >= KEPT:
            self.old, self.young = self.young, {w: self.young[w] for w in seen if w in self.young}
        self.young.update((w, ids) for w, ids in found.items() if len(w) <= KEPT_CHARS)
        long = {w: ids for w, ids in found.items() if len(w) > KEPT_CHARS}
        young = self.young
        if long:
            return [b"".join([young.get(w) or long[w] for w in words]) for words in split]
        return [b"".join([young[w] for w in words]) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_all(list(parts(text)))), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, some SLICE ids at a time."""
        out = []
        for k in range(0, len(ids), SLICE):
            mine = ids[k : k + SLICE]
            size = self.length[mine]
            shift = self.start[mine] - (np.cumsum(size) - size)
            out.append(self.flat[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


def parts(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters. Before a single blank between other characters every
    pattern of this kind begins a new pre-token, so parts are encoded like the whole."""
    at = 0
    while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(1)
def model(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, and ids (array<int>) with decoded (binary), or with digests their
    SHA-256 (ids as little-endian unsigned 32-bit integers).

    ranks is the path of a file of ranks, present on every executor; pattern cuts texts into pre-tokens. Null
    counts as empty; an empty text has no ids and decodes to no bytes. Whole texts are encoded, however long.
    Repeated rows and null ids come back as they are. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    names = ["id", "n_tokens", *[x.split()[0] for x in tail.split(", ")]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks, pattern)
        for batch in batches:
            ids_of: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            held: list[tuple[int, str]] = []
            size = 0

            def settle() -> None:
                for (k, _), ids in zip(held, bpe.encode_all([part for _, part in held])):
                    ids_of[k].append(ids)
                held.clear()

            for k, text in enumerate(batch.column(1)):
                for part in parts(text.as_py() or ""):
                    held.append((k, part))
                    size += len(part)
                    if size >= SLICE:
                        settle()
                        size = 0
            settle()
            raw = [b"".join(x) for x in ids_of]
            n = np.array([len(x) // 4 for x in raw], np.int64)
            decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in raw]
            if digests:
                cols = [pa.array([hashlib.sha256(x).hexdigest() for x in of], pa.string()) for of in (raw, decoded)]
            else:
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                cols = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *cols], names)

    return rows.mapInArrow(encode, f"id {kind}, n_tokens bigint, {tail}").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary), the bytes of an array of ids; null or empty arrays decode to no bytes."""

    @F.pandas_udf("binary")
    def decode(ids):  # noqa: ANN001
        bpe = model(ranks, pattern)
        return ids.map(lambda x: bpe.decode(np.asarray(x, np.int64)) if x is not None else b"")

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
