"""Byte-level BPE over padded matrices: encoding and decoding with a file of ranks.

A text is split by the vocabulary's pattern. Matches that are tokens themselves are looked up; all others are put, as rows of byte
tokens, into matrices by length, padded at the end. In each round every row merges its leftmost pair of least rank: pairs are looked up in
an open-addressed hash table, only the two pairs around a merge are looked up again, and the merged place is cut out, so that all rows
of a matrix lose one column a round. Rows without a pair to merge leave the matrix. Matches of more than `LONG` bytes would make
that quadratic, so each is a row of its own, in which all pairs of the least rank are merged at once as long as
none of these merges makes a pair of a lesser rank (the first that does ends the round): the same result.

Matches are remembered up to a bound per worker; this and the rounds within a batch change cost only.

Input: null texts count as empty (no ids, digests of nothing). Every row is kept, also rows that repeat an id and rows without one; an empty table
gives no rows; columns other than doc_id and text are left out. Texts of any length are encoded whole: a batch is worked on in runs of
about `CHARS` characters, and one longer text is a run of its own.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, mix, ready

NONE = np.int32(2**31 - 1)
LONG = 96
CHARS = 4_000_000
REMEMBERED = 600_000

# Characters that the `regex` module classes as letters, digits or marks by a later Unicode version than the public encoder
# does, for which they are unassigned. A test compares every character.
UNASSIGNED = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The usual pattern, said without classes for texts of common characters, which the standard library then splits much faster.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
UNCOMMON = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ſ–—‘’“”•…€]")
COMMON = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
BEYOND = re.compile("[\u0558-\U0010ffff]")  # a quick test first


class Pairs:
    """Rank of the token that two tokens make, by an open-addressed table with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.size = np.int64(size)
        keys = np.fromiter((a * size + b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of keys that meet the last one stays
            placed = self.keys[slots[left]] == keys[left]
            self.values[slots[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks by element; NONE where the two make no token, or one is negative."""
        keys = a.astype(np.int64) * self.size + b
        keys[(a < 0) | (b < 0)] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        left = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[left]]
            hit = found == keys.flat[left] if keys.ndim > 1 else found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class RankFile:
    """A vocabulary given as ranks of byte strings, and the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.unassigned = re.compile(f"[{UNASSIGNED}]")
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = Pairs(pairs, size)
        #: By match: its ids in machine form.
        self.known: dict[str, bytes] = {}
        for token, rank in self.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):  # part of a character: no match by itself
                self.known[token.decode()] = array("I", [rank]).tobytes()
        self.decimals = [str(i) for i in range(size)]

    def split(self, text: str) -> list[str]:
        if self.pattern.pattern == USUAL and not UNCOMMON.search(text):
            return COMMON.findall(text)
        if not BEYOND.search(text) or not self.unassigned.search(text):
            return self.pattern.findall(text)
        plain, out, at = self.unassigned.sub("\ue000", text), [], 0  # private use: neither letter nor digit nor space
        for match in self.pattern.findall(plain):
            out.append(text[at : at + len(match)])
            at += len(match)
        return out

    def merged(self, rows: np.ndarray) -> list[bytes]:
        """Ids, in machine form, of rows of byte tokens, padded with -1 at the end."""
        out: list = [None] * len(rows)
        ranks, alive = self.pairs(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1), np.arange(len(rows))
        while len(alive):
            here = np.arange(len(alive))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(alive), np.int64)
            least = ranks[here, at] if ranks.shape[1] else np.full(len(alive), NONE)
            ended = least == NONE
            if ended.any():
                final = rows[ended]
                given = final >= 0
                raw, stops = final[given].astype(np.uint32).tobytes(), np.cumsum(given.sum(1)) * 4
                for k, i, j in zip(alive[ended].tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    out[k] = raw[i:j]
                go = ~ended
                rows, ranks, alive, at, least = rows[go], ranks[go], alive[go], at[go], least[go]
                here = np.arange(len(alive))
                if not len(alive):
                    break
            n, width = rows.shape
            rows[here, at] = least
            stay = np.ones((n, width), bool)
            stay[here, at + 1] = False
            rows = rows[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[here, at] = False
            ranks = ranks[stay].reshape(n, width - 2)
            inner = np.flatnonzero(at > 0)
            if len(inner):
                ranks[inner, at[inner] - 1] = self.pairs(rows[inner, at[inner] - 1], least[inner])
            inner = np.flatnonzero(at < width - 2)
            if len(inner):
                ranks[inner, at[inner]] = self.pairs(least[inner], rows[inner, at[inner] + 1])
        return out

    def merged_long(self, ids: np.ndarray) -> list[int]:
        """Ids of one long row: per round all pairs of the least rank, up to the first that makes a pair of a lesser one."""
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:  # pairs that overlap: every other one of each run, from its left
                first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
                before = np.where(at > 0, ids[at - 1], -1)
                before[1:][at[1:] - at[:-1] == 2] = least
                after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                lone = np.full(len(at), least, np.int32)
                lesser = np.flatnonzero((self.pairs(before, lone) < least) | (self.pairs(lone, after) < least))
                if len(lesser):
                    at = at[: lesser[0] + 1]
            ids[at] = least
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, ranks = ids[stay], ranks[stay[1:]]
            new = at - np.arange(len(at))  # where the merged tokens are now
            for side in (new[new > 0] - 1, new[new < len(ids) - 1]):
                ranks[side] = self.pairs(ids[side], ids[side + 1])
        return ids.tolist()

    def encode_matches(self, matches: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each match, none of them a token itself, with its ids in machine form, in no order."""
        raws = [match.encode() for match in matches]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for i in np.flatnonzero(sizes > LONG).tolist():
            yield matches[i], array("I", self.merged_long(self.byte[np.frombuffer(raws[i], np.uint8)])).tobytes()
        width = -(-sizes // 4) * 4
        bucketed = np.argsort(width, kind="stable")
        bucketed = bucketed[sizes[bucketed] <= LONG]
        for bucket in np.split(bucketed, np.flatnonzero(np.diff(width[bucketed])) + 1):
            for start in range(0, len(bucket), 16_384):
                part = bucket[start : start + 16_384]
                own = part.tolist()
                rows = np.full((len(own), width[own[0]]), -1, np.int32)
                rows[np.arange(rows.shape[1]) < sizes[part, None]] = self.byte[np.frombuffer(b"".join([raws[i] for i in own]), np.uint8)]
                yield from zip([matches[i] for i in own], self.merged(rows), strict=True)

    def encoded(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        start = 0
        while start < len(texts):
            stop, chars, parts = start, 0, []
            while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= CHARS):
                parts.append(self.split(texts[stop] or ""))
                chars += len(texts[stop] or "")
                stop += 1
            table = self.known
            unseen = set().union(*parts).difference(table)
            if len(table) + len(unseen) > REMEMBERED:  # the worker's memory is full: this run has a table of its own
                table = {m: table[m] for m in set().union(*parts).difference(unseen)}
            table.update(self.encode_matches(list(unseen)))
            for matches in parts:
                yield np.frombuffer(b"".join(map(table.__getitem__, matches)), np.uint32).tolist()
            start = stop

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_loaded: dict[tuple[str, str], RankFile] = {}


def rank_file(path: str, pattern: str) -> RankFile:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = RankFile(path, pattern)
    return _loaded[path, pattern]


def _rows(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row's whole text."""

    def step(batch):
        return {"doc_id": batch.column("doc_id"), "ids": list(rank_file(ranks, pattern).encoded(batch.column("text").to_pylist()))}

    return in_batches(_rows(docs), "doc_id long, ids array<int>", step)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ids; null ids count as none, and an id outside the vocabulary is an error."""

    def step(batch):
        own = rank_file(ranks, pattern)
        return {"doc_id": batch.column("doc_id"), "decoded": [own.decoded(ids or []) for ids in batch.column("ids").to_pylist()]}

    return in_batches(encoded.select("doc_id", "ids"), "doc_id long, decoded binary", step)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encode and decode in one step: number of ids, digests of the ids and of the bytes that they decode to."""
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def step(batch):
        out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        own = rank_file(ranks, pattern)
        for ids in own.encoded(batch.column("text").to_pylist()):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha(",".join([own.decimals[i] for i in ids]).encode()))
            out["decoded_sha256"].append(sha(own.decoded(ids)))
        return {"doc_id": batch.column("doc_id")} | out

    return in_batches(_rows(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", step)
