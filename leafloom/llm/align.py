"""Alignment of the tokens of two tokenizers by the bytes that they end at.

Both tokenizers cut the same bytes: a space and the text. The ends of all A tokens and of all B tokens of a run of documents are two sorted
lists (each document begins where the one before it ends). Diagonals of their merge grid at equal distances are met with the merge path by
binary search, which divides the merging into pieces of equal work, wherever documents begin. Each piece is merged by itself and
emits the overlaps of its A and B tokens (with their common bytes) and the ends that it finds in both lists; an end whose two tokens fall into
different pieces is found when neighbouring pieces are stitched. Shared ends cut the tokens into groups, and the two tokens that
end there are a link.

Counts of linked id pairs over the corpus are summed from one row per block and pair, not per document, and come back to the blocks in the
same form: a pair that stands in every document is one row per block. A block is a batch of documents, so what
one task holds is bounded by the batch, and by one document.

Input: texts that are null or empty, or whose tokens do not join to space and text (A or B: a literal U+2581, for example), have no tokens:
zeros and ''. Every row is kept, also rows that repeat an id or have none; an empty table gives no rows. Columns other than doc_id and text are left
out. Long texts are aligned whole; pieces bound the memory of a merge, not what is merged. Pairs with equal counts are all best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, ready, written
from leafloom.llm.packing import ByteLevel
from leafloom.llm.pieces import SPACE, piece_model

STEPS = 65_536  # merge steps of a piece
RUN_CHARS = 2_000_000
SHIFT = 20  # a pair of ids as one number: a << SHIFT | b


def path_cuts(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals `steps` apart, both corners included, meet the merge path: how many of a and of b lie before. Equal ends: a comes first."""
    diagonals = np.append(np.arange(0, len(a) + len(b), steps), len(a) + len(b))
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        j = diagonals - i
        right = np.zeros(len(i), bool)  # a[i] is merged before b[j - 1]: the path passes further along a
        right[open_] = a[i[open_]] <= b[j[open_] - 1]
        low, high = np.where(open_ & right, i + 1, low), np.where(open_ & ~right, i, high)
    return low, diagonals - low


@dataclass
class Piece:
    """Overlaps (numbers of the two tokens, common bytes) in order, and pairs of tokens that end together."""

    over_a: np.ndarray
    over_b: np.ndarray
    size: np.ndarray
    shared_a: np.ndarray
    shared_b: np.ndarray


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Piece:
    """Merges a[i0:i1] with b[j0:j1]; the piece begins at the last end before it. Needs no other piece."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    ends = np.concatenate([own_a, own_b])
    order = np.argsort(ends, kind="stable")  # equal ends: a comes first
    ends = ends[order]
    from_a = order < i1 - i0
    at_a = i0 + np.cumsum(from_a) - from_a  # tokens that are open while a step is taken
    at_b = j0 + np.cumsum(~from_a) - ~from_a
    begin = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    size = np.diff(ends, prepend=begin)
    full = size > 0
    place = np.searchsorted(own_b, own_a)
    hit = place < len(own_b)
    hit[hit] = own_b[place[hit]] == own_a[hit]
    return Piece(at_a[full], at_b[full], size[full], i0 + np.flatnonzero(hit), j0 + place[hit])


def pieces(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Iterator[Piece]:
    """The pieces in order, each with the shared end at its left edge that only it and its neighbour together show."""
    cut_a, cut_b = path_cuts(a, b, steps)
    for k in range(len(cut_a) - 1):
        i0, i1, j0, j1 = (int(x) for x in (cut_a[k], cut_a[k + 1], cut_b[k], cut_b[k + 1]))
        piece = merge_piece(a, b, i0, i1, j0, j1)
        if i0 and j0 < j1 and a[i0 - 1] == b[j0]:
            piece.shared_a, piece.shared_b = np.insert(piece.shared_a, 0, i0 - 1), np.insert(piece.shared_b, 0, j0)
        yield piece


class PlainByteLevel(ByteLevel):
    """Special tokens' strings inside a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.whole.encode_special_tokens = True
        self.special = []


class Both:
    """The two tokenizers, and what bytes their ids stand for."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = PlainByteLevel(byte_path), piece_model(piece_path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
        vocabulary = self.a.whole.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        b_bytes = [raw.replace(SPACE.encode(), b" ") for raw in self.b.bytes]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, b_bytes))
        #: What stands for a token in the text of the groups: an A token, the last of its group, a B token, the last of its group.
        self.said = [f"{i}{mark}" for size, marks in ((len(self.a_sizes), ",|"), (len(self.b_sizes), ",;")) for i in range(size) for mark in marks]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        whole = " " + text
        a, raw = self.a.ids(whole), whole.encode()
        b, _, pieces_raw, _ = self.b.encode(text)
        if pieces_raw.replace(SPACE.encode(), b" ") != raw or b"".join([self.a_bytes[i] for i in a]) != raw:
            return [], []
        return a, b


_loaded: dict[tuple[str, str], Both] = {}


def both(byte_path: str, piece_path: str) -> Both:
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Both(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


@dataclass
class Aligned:
    """A run of documents: where each one's tokens begin, all ids, and the pieces of their merge."""

    first_a: np.ndarray
    first_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    pieces: list[Piece]

    @property
    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that end together, in order."""
        none = [np.zeros(0, np.int64)]
        return np.concatenate([p.shared_a for p in self.pieces] or none), np.concatenate([p.shared_b for p in self.pieces] or none)


def runs(own: Both, texts: list[str | None]) -> Iterator[Aligned]:
    """The texts in order, some at a time, aligned."""
    start = 0
    while start < len(texts):
        stop, chars, parts = start, 0, []
        while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= RUN_CHARS):
            parts.append(own.tokens(texts[stop]))
            chars += len(texts[stop] or "")
            stop += 1
        first_a, first_b = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 1))
        a, b = (np.concatenate([np.array(p[k], np.int64) for p in parts]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
        yield Aligned(first_a, first_b, a, b, list(pieces(ends_a, ends_b)))
        start = stop


def overlaps(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document the overlaps of its tokens in order: a_at, b_at (places of the tokens), bytes (common ones), and end_together (the link)."""

    def step(batch):
        own, out = both(byte_path, piece_path), {k: [] for k in ("a_ids", "b_ids", "a_at", "b_at", "bytes", "end_together")}
        for run in runs(own, batch.column("text").to_pylist()):
            none = [np.zeros(0, np.int64)]
            over_a, over_b, size = (np.concatenate([getattr(p, k) for p in run.pieces] or none) for k in ("over_a", "over_b", "size"))
            shared = set(zip(*(x.tolist() for x in run.shared), strict=True))
            cut = np.searchsorted(over_a, run.first_a)
            for k in range(len(run.first_a) - 1):
                here = slice(cut[k], cut[k + 1])
                a_at, b_at = over_a[here], over_b[here]
                out["a_ids"].append(run.a[run.first_a[k] : run.first_a[k + 1]])
                out["b_ids"].append(run.b[run.first_b[k] : run.first_b[k + 1]])
                out["a_at"].append(a_at - run.first_a[k])
                out["b_at"].append(b_at - run.first_b[k])
                out["bytes"].append(size[here])
                out["end_together"].append([p in shared for p in zip(a_at.tolist(), b_at.tolist(), strict=True)])
        return {"doc_id": batch.column("doc_id")} | out

    kinds = "doc_id long, a_ids array<long>, b_ids array<long>, a_at array<long>, b_at array<long>, bytes array<long>, end_together array<boolean>"
    return in_batches(_rows(docs), kinds, step)


LINKS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>, block string, block_pairs array<long>, block_times array<long>"


def _rows(docs: DataFrame) -> DataFrame:
    spark = ready(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def links(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document its counts, the digest of its groups, its linked id pairs with their times; the first row of a block also has the sums of the block."""
    state: dict = {}

    def step(batch):
        own = both(byte_path, piece_path)
        out: dict = {k: [] for k in ("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")}
        for run in runs(own, batch.column("text").to_pylist()):
            shared_a, shared_b = run.shared
            keys = run.a[shared_a] << SHIFT | run.b[shared_b]
            groups = np.searchsorted(shared_a, run.first_a)
            last_a, last_b = np.zeros(len(run.a), np.int64), np.zeros(len(run.b), np.int64)
            last_a[shared_a], last_b[shared_b] = 1, 1
            code = np.concatenate([2 * run.a + last_a, 2 * (run.b + len(own.a_sizes)) + last_b])
            place = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])  # group, A before B
            code, first = code[np.argsort(place, kind="stable")].tolist(), (run.first_a + run.first_b).tolist()
            for k in range(len(first) - 1):
                pairs, times = np.unique(keys[groups[k] : groups[k + 1]], return_counts=True)
                said = "".join([own.said[c] for c in code[first[k] : first[k + 1]]])[:-1]
                out["n_a"].append(run.first_a[k + 1] - run.first_a[k])
                out["n_b"].append(run.first_b[k + 1] - run.first_b[k])
                out["n_groups"].append(groups[k + 1] - groups[k])
                out["groups_sha256"].append(hashlib.sha256(said.encode()).hexdigest() if said else "")
                out["pairs"].append(pairs)
                out["times"].append(times)
        size = len(out["n_a"])
        task = TaskContext.get()
        here = (task.stageId(), task.partitionId(), task.taskAttemptId())
        number = state.get(here, 0)
        state.clear()
        state[here] = number + 1
        every, place = np.unique(np.concatenate(out["pairs"]), return_inverse=True)
        sums = np.bincount(place, np.concatenate(out["times"]), len(every)).astype(np.int64)
        rest = [None] * (size - 1)
        return {"doc_id": batch.column("doc_id"), "block": [f"{task.partitionId()}-{number}"] * size, "block_pairs": [every, *rest], "block_times": [sums, *rest]} | out

    return in_batches(_rows(docs), LINKS, step)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, count (links over the corpus that hold it linked), best (no pair of its B id has more)."""
    rows = linked.where(F.col("block_pairs").isNotNull()).select(F.explode(F.arrays_zip("block_pairs", "block_times")).alias("x"))
    sums = rows.groupBy(F.col("x.block_pairs").alias("pair")).agg(F.sum("x.block_times").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1))  # at most one row per A id
    return sums.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    linked = written(links(docs, byte_path, piece_path), "links")
    asked = linked.where(F.col("block_pairs").isNotNull()).select("block", F.explode("block_pairs").alias("pair"))
    told = asked.join(pair_counts(linked), "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("known"))
    told = told.select(F.col("block").alias("of_block"), F.col("known.pair").alias("known"), F.col("known.count").alias("counts"), F.col("known.best").alias("best"))
    own = linked.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def resolve(rows, block):
        import pyarrow as pa

        pairs, times = (rows.column(c).combine_chunks() for c in ("pairs", "times"))
        offsets = pairs.offsets.to_numpy().astype(np.int64)
        pairs, times = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pairs, times))
        if block.num_rows:
            known, counts, best = (block.column(c).combine_chunks()[0].values.to_numpy(zero_copy_only=False) for c in ("known", "counts", "best"))
            order = np.argsort(known)
            place = order[np.searchsorted(known, pairs, sorter=order)]
            counts, best = counts[place] * times, best[place] * times
        else:  # no pair in the whole block
            counts = best = np.zeros(0, np.int64)
        sums = [np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (times, best, counts)]
        columns = {c: rows.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        columns |= dict(zip(("n_links", "n_best", "count_sum"), map(pa.array, sums), strict=True))
        return pa.table({f: columns[f] for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    return own.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(resolve, schema)
