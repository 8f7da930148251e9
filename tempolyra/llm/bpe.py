"""BPE encoding and decoding by a tokenization automaton.

States stand for the token read last, arcs for the next token; at first every arc exists. The rules are
gone through in merge order, and the gadget of a rule (u, v) removes every arc that would leave u and v
side by side when its turn comes: those from tokens that still end in u then to tokens that still begin
with v then. Tokens are numbered so that both sides are ranges (each token after those that it ends, or
begins, ordered by when they were made), so a gadget is one rectangle, and the compiled table holds the
removed ranges of each state in order: under a million for 49,000 rules. A token sequence that the
automaton accepts is the one that BPE makes of its text.

The automaton reads bytes through a second table, the trie of the tokens with its failure arcs: for each
byte it gives the longest token that ends there. The beginning of a word up to any byte has one accepted
sequence, so the state there is the first of the tokens ending there, longest first, whose arc exists.
Words not met before are encoded together, one byte of all of them a step, by look-ups in these tables.
Decoding emits the arcs' labels. One pass over the rows, no shuffle; a worker's tables have a fixed size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words kept by a worker in each of two generations, and the longest that is kept.
KEPT_WORDS, KEPT_CHARS = 64_000, 64
#: Characters of texts whose words are taken at once; a longer text is cut between words.
SLICE = 1 << 20
#: Words over so many bytes are read one by one; so many bytes of shorter ones are read together.
LONG, TOGETHER = 96, 1 << 20
#: Beginnings of up to so many bytes have a whole row in the trie's table.
NEAR = 2

#: Separators of str.split() that are not white space for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class Order:
    """Numbers of the tokens along one side: a token comes after those that have it as this side's part."""

    def __init__(self, made: np.ndarray, part: np.ndarray):
        n = len(made)
        self.inside: list[list[int]] = [[] for _ in range(n)]
        for t in np.argsort(made, kind="stable").tolist():
            if made[t] >= 0:
                self.inside[part[t]].append(t)
        self.turns = [[int(made[t]) for t in x] for x in self.inside]
        self.first, self.at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        count = 0
        for root in np.nonzero(made < 0)[0].tolist():
            stack = [(root, 0)]
            while stack:
                t, k = stack.pop()
                if not k:
                    self.first[t] = count
                if k < len(self.inside[t]):
                    stack += [(t, k + 1), (self.inside[t][k], 0)]
                else:
                    self.at[t], count = count, count + 1

    def still(self, t: int, k: int) -> int:
        """First number of the range of tokens in which t is not part of anything larger; the k first tokens
        made of t are out. The range ends with t itself."""
        return int(self.first[self.inside[t][k]] if k < len(self.inside[t]) else self.at[t])


def gadgets(rules: list[tuple[int, int]], made: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of removed arcs: by state (its number `at` in the order of ends), sorted keys
    state << 32 | first removed and the last removed of each range; and each token's number in the order of
    beginnings. A token that the rule itself makes has taken its part already if it stands to the left."""
    ends, begins = Order(made, right), Order(made, left)
    box = np.array(
        [(ends.still(u, bisect_right(ends.turns[u], k)), ends.at[u], begins.still(v, bisect_left(begins.turns[v], k)), begins.at[v]) for k, (u, v) in enumerate(rules)],
        np.int64,
    ).reshape(-1, 4)
    size = box[:, 1] - box[:, 0] + 1
    row = np.repeat(box[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    low, high = np.repeat(box[:, 2], size), np.repeat(box[:, 3], size)
    order = np.lexsort((low, row))
    key, stop = row[order] << 32 | low[order], np.maximum.accumulate(row[order] << 32 | high[order])
    # ranges that lie within those before them say nothing new
    new = np.ones(len(key), bool)
    new[1:] = key[1:] > stop[:-1]
    first = np.nonzero(new)[0]
    token_at = np.zeros(len(made), np.int64)
    token_at[ends.at] = np.arange(len(made))
    state = token_at[key[first] >> 32]
    again = np.argsort(state, kind="stable")
    last = np.append(first[1:] - 1, len(key) - 1)[: len(first)]
    mask = (1 << 32) - 1
    return (state[again] << 32 | (key[first] & mask)[again]), (state[again] << 32 | (stop[last] & mask)[again]), begins.at


class Automaton:
    """The compiled model of a tokenizer file with byte symbols and a word-end mark."""

    def __init__(self, path: str, keep_labels: bool = True):
        self.keep_labels = keep_labels
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.labels = [""] * n
        for t, i in [*ids.items(), *self.special.items()]:
            self.labels[i] = t
        made, left, right = (np.full(n, -1) for _ in range(3))
        rules = []
        for k, pair in enumerate(model["merges"]):
            u, v = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = ids[self.labels[u] + self.labels[v]]
            if made[w] >= 0:
                raise ValueError(f"two rules make {self.labels[w]!r}")
            made[w], left[w], right[w] = k, u, v
            rules.append((u, v))
        self.removed, self.until, self.begin = gadgets(rules, made, left, right)
        self._read_by_bytes({i: t for t, i in ids.items() if i not in self.special.values()}, end)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _read_by_bytes(self, tokens: dict[int, str], end: str) -> None:
        """The trie of the tokens' beginnings, shorter ones first: `near` (state, byte -> state) for those of up to
        NEAR bytes, and for the others their own arcs `arcs` (state << 8 | byte) to `to` and the state `fail` to
        go on from where there is none. By state the longest token that ends in it within a word (`inner`) or at
        its end (`final`); by token its size and the next shorter one that ends there."""
        byte = {c: b for b, c in enumerate(byte_symbols())}
        spelt = {i: bytes(byte[c] for c in t.removesuffix(end)) for i, t in tokens.items()}
        ends = {i for i, t in tokens.items() if t.endswith(end)}
        prefixes = sorted({s[:k] for s in spelt.values() for k in range(len(s) + 1)}, key=lambda s: (len(s), s))
        place = {s: k for k, s in enumerate(prefixes)}
        m, depth = len(prefixes), np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        up = np.array([place[s[:-1]] for s in prefixes])
        sym = np.array([s[-1] if s else 0 for s in prefixes])
        order = np.argsort(up[1:] << 8 | sym[1:]) + 1
        self.arcs, self.to = (up << 8 | sym)[order], order.astype(np.int32)
        self.near = np.zeros((int((depth <= NEAR).sum()), 256), np.int32)
        self.fail = np.zeros(m, np.int32)
        found = np.full((2, m), -1, np.int32)
        for i, s in spelt.items():
            found[int(i in ends), place[s]] = i
        for d in range(int(depth.max()) + 1):
            at, kids = np.nonzero(depth == d)[0], np.nonzero(depth == d + 1)[0]
            if d > 1:
                self.fail[at] = self._next(self.fail[up[at]], sym[at])
            for kind in found:
                kind[at] = np.where(kind[at] >= 0, kind[at], kind[self.fail[at]])
            if d <= NEAR:
                self.near[at] = self.near[self.fail[at]] if d else 0
                self.near[up[kids], sym[kids]] = kids
        self.inner, self.final = found
        n = len(self.labels)
        self.size, self.shorter = np.zeros(n, np.int64), np.full(n, -1, np.int32)
        for i, s in spelt.items():
            self.size[i], self.shorter[i] = len(s), found[int(i in ends), self.fail[place[s]]]

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after each state and byte."""
        out, open_, s = np.zeros(len(state), np.int32), np.arange(len(state)), state
        while len(open_):
            near = s < len(self.near)
            out[open_[near]] = self.near[s[near], byte[open_[near]]]
            open_, s = open_[~near], s[~near]
            key = s.astype(np.int64) << 8 | byte[open_]
            k = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[k] == key
            out[open_[hit]] = self.to[k[hit]]
            open_, s = open_[~hit], self.fail[s[~hit]]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the arc from state a to token b exists; a = -1 stands for a word's beginning."""
        key = a.astype(np.int64) << 32 | self.begin[b]
        k = np.searchsorted(self.removed, key, "right") - 1
        return (a < 0) | (k < 0) | (self.until[k] < key)

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, list[int], list[int]]:
        """The accepted token sequences of the words: all tokens, and by word its first and the one past its last."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        flat, sizes, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(order):
            longest = len(words[order[at]])
            group = order[at : at + (max(1, TOGETHER // longest) if longest <= LONG else 1)]
            tokens, size = self._together([words[k] for k in group]) if longest <= LONG else self._alone(words[group[0]])
            flat.append(tokens)
            sizes.append(size)
            at += len(group)
        size = np.concatenate(sizes)
        stop = np.zeros(len(words), np.int64)
        stop[order] = np.cumsum(size)
        start = stop.copy()
        start[order] -= size
        return np.concatenate(flat), start.tolist(), stop.tolist()

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and their number by word, of words of falling length: one byte of all a step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = int(size[0])
        text = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n).T.copy()
        state, last = np.zeros(len(words), np.int32), np.full((n + 1, len(words)), -1, np.int32)

        def settle(token: np.ndarray, row: np.ndarray, end: np.ndarray | int) -> np.ndarray:
            """The first token, longest first, that may follow the state where it begins."""
            open_ = np.arange(len(token))
            while len(open_):
                t, r = token[open_], row[open_]
                begin = (end if isinstance(end, int) else end[open_]) - self.size[t]
                open_ = open_[~self.follows(last[begin, r], t)]
                token[open_] = self.shorter[token[open_]]
            return token

        for k in range(n):
            m = int(np.searchsorted(-size, -k, "left"))  # words of over k bytes
            state[:m] = self._next(state[:m], text[k, :m])
            done = int(np.searchsorted(-size, -(k + 1), "left"))  # those that go on after this byte
            last[k + 1, :done] = settle(self.inner[state[:done]], np.arange(done), k + 1)
            last[k + 1, done:m] = settle(self.final[state[done:m]], np.arange(done, m), k + 1)
        # back from the ends
        row, end, found = np.arange(len(words)), size.copy(), []
        while len(row):
            t = last[end, row]
            found.append((row, t))
            end = end - self.size[t]
            row, end = row[end > 0], end[end > 0]
        rows, tokens = np.concatenate([r for r, _ in found])[::-1], np.concatenate([t for _, t in found])[::-1]
        by_word = np.argsort(rows, kind="stable")
        return tokens[by_word].astype(np.uint32), np.bincount(rows, minlength=len(words))

    def _alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long word, byte by byte."""
        inner, shorter, size, begin, arcs = self.inner, self.shorter, self.size, self.begin, memoryview(self.arcs)
        removed, until = memoryview(self.removed), memoryview(self.until)
        last, state = np.full(len(word) + 1, -1, np.int32), 0
        at_end = len(word)
        for k, b in enumerate(word, 1):
            while state >= len(self.near):
                r = bisect_left(arcs, state << 8 | b)
                if r < len(arcs) and arcs[r] == state << 8 | b:
                    state = int(self.to[r])
                    break
                state = int(self.fail[state])
            else:
                state = int(self.near[state, b])
            token = int(inner[state] if k < at_end else self.final[state])
            while True:
                before = int(last[k - size[token]])
                if before < 0:
                    break
                key = before << 32 | int(begin[token])
                r = bisect_right(removed, key) - 1
                if r < 0 or until[r] < key:
                    break
                token = int(shorter[token])
            last[k] = token
        path, end = [], at_end
        while end:
            path.append(last[end])
            end -= int(size[last[end]])
        return np.array(path[::-1], np.uint32), np.array([len(path)])

    def _learn(self, chunks: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Ids as bytes, and labels, of texts without white space."""
        chunks = list(chunks)
        words: dict[bytes, int] = {}
        plan: list[list[int]] = []  # by chunk: a word's place, or a special token's id below zero
        for chunk in chunks:
            mine: list[int] = []
            for part in self.specials.split(chunk) if self.specials else [chunk]:
                if part in self.special:
                    mine.append(-1 - self.special[part])
                    continue
                if part.isascii():
                    part = part.lower()
                    pieces = [part] if part.isalpha() else self.pieces.findall(part)
                else:
                    part = unicodedata.normalize("NFC", part)
                    part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
                    pieces = self.pieces.findall(part)
                mine += [words.setdefault(piece.encode(), len(words)) for piece in pieces]
            plan.append(mine)
        flat, start, stop = self.paths(list(words))
        raw, labels, out = flat.astype("<u4").tobytes(), [self.labels[i] for i in flat.tolist()] if self.keep_labels else [], {}
        for chunk, mine in zip(chunks, plan):
            if len(mine) == 1 and (k := mine[0]) >= 0:
                out[chunk] = raw[4 * start[k] : 4 * stop[k]], " ".join(labels[start[k] : stop[k]])
            else:
                parts = [(raw[4 * start[k] : 4 * stop[k]], " ".join(labels[start[k] : stop[k]])) if k >= 0 else ((-1 - k).to_bytes(4, "little"), self.labels[-1 - k]) for k in mine]
                out[chunk] = b"".join([ids for ids, _ in parts]), " ".join([text for _, text in parts])
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text its ids as little-endian 32-bit integers, and the labels that they decode to if kept."""
        split = [text.split() if not _ODD.search(text) else [w for w in _SPACE.split(text) if w] for text in texts]
        new = {w for words in split for w in words} - self.young.keys()
        found = {w: self.old[w] for w in new if w in self.old}
        found |= self._learn(new - found.keys())
        self.young.update((w, f) for w, f in found.items() if len(w) <= KEPT_CHARS)
        long = {w: f for w, f in found.items() if len(w) > KEPT_CHARS}
        get, out = self.young.get, []
        for words in split:
            parts = [get(w) or long[w] for w in words]
            out.append((b"".join([ids for ids, _ in parts]), " ".join([labels for _, labels in parts]) if self.keep_labels else ""))
        if len(self.young) >= KEPT_WORDS:
            self.old, self.young = self.young, {}
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs taken, joined by one space, as a tokenizer without a decoder joins them."""
        return " ".join([self.labels[i] for i in ids])


def slices(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Groups of (text, part of it) of some SLICE characters; parts end between words."""
    held, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            cut = _SPACE.search(text, at + SLICE) if len(text) - at > SLICE else None
            held.append((k, text[at : cut.start()] if cut else text[at:]))
            size += len(held[-1][1])
            if size >= SLICE:
                yield held
                held, size = [], 0
            if not cut:
                break
            at = cut.end()
    if held:
        yield held


@lru_cache(1)
def automaton(path: str, keep_labels: bool = True) -> Automaton:
    return Automaton(path, keep_labels)


def encode_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decode: bool = True
) -> DataFrame:
    """One row per input row: id, n_tokens, and ids (array<int>) with decoded (string, unless decode is
    false), or with digests their SHA-256 (ids as little-endian unsigned 32-bit integers, decoded text as
    UTF-8).

    tokenizer is the path of a tokenizer file, present on every executor. Null counts as empty; an
    empty text has no ids and decodes to the empty text. Whole texts are encoded, however long.
    Repeated rows and null ids come back as they are. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded string" * decode
    names = ["id", "n_tokens", *[x.split()[0] for x in tail.split(", ")]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = automaton(tokenizer, digests or decode)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids_of: list[list[bytes]] = [[] for _ in texts]
            labels_of: list[list[str]] = [[] for _ in texts]
            for part in slices(texts):
                for (k, _), (ids, labels) in zip(part, model.encode_all([t for _, t in part])):
                    ids_of[k].append(ids)
                    if labels:
                        labels_of[k].append(labels)
            raw = [b"".join(x) for x in ids_of]
            text = [" ".join(x) for x in labels_of]
            n = np.array([len(ids) // 4 for ids in raw], np.int64)
            if digests:
                raw = [hashlib.sha256(ids).hexdigest() for ids in raw]
                text = [hashlib.sha256(t.encode()).hexdigest() for t in text]
            if digests:
                first = pa.array(raw, pa.string())
            else:
                first = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"))
                )
            cols = [batch.column(0), pa.array(n), first, *([pa.array(text, pa.string())] if digests or decode else [])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(encode, f"id {kind}, n_tokens bigint, {tail}").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, the text of an array of ids; null or empty arrays decode to the empty text."""

    @F.pandas_udf("string")
    def decode(ids):  # noqa: ANN001
        model = automaton(tokenizer)
        return ids.map(lambda x: model.decode(list(x)) if x is not None else "")

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
