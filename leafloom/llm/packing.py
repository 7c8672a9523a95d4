"""Packing: all documents are written one after the other and cut into windows of a fixed length.

Pass one encodes each document, and notes the tokens before it within its partition; the tokens are written as a table, which fixes
the order. Totals of the partitions, one row each, are summed up to global offsets. Pass two adds them and cuts at
multiples of the window: one boundary record for each piece. Only the very last window can be short, so padding is
below one window for the whole corpus.

Null texts count as empty (one end id). Repeated rows are packed as often as they occur, rows without an id too.
An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, ready, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteLevel:
    """Ids of a byte-level BPE vocabulary as the tokenizers library gives them.

    Texts of characters that both libraries class alike (`UNSAFE` finds any other) are merged with tiktoken over the ranks in the
    same file, all others by the tokenizers library itself. Where no two white-space characters meet, the pattern needs no look-ahead, which is
    much faster.
    """

    UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡-ſ–—‘’“”•…€]")
    RUN = re.compile(r"\s\s")
    PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    PATTERN = PLAIN.replace(r"|\s+", r"|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.plain, self.runs = (tiktoken.Encoding("parts", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (self.PLAIN, self.PATTERN))
        self.wide = np.dtype("<u4") if self.whole.get_vocab_size() > 65_536 else np.dtype("<u2")

    def ids(self, text: str) -> list[int]:
        if self.UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.runs(text) if self.RUN.search(text) else self.plain(text)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of `self.wide`."""
        return array(self.wide.char, self.ids(text)).tobytes()


_loaded: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    if path not in _loaded:
        _loaded[path] = ByteLevel(path)
    return _loaded[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, part, before (tokens before it in its partition), n, wide (bytes an id takes), ids."""

    state: dict = {}

    def step(batch):
        coder = byte_level(tokenizer)
        end = np.array([end_id], coder.wide).tobytes()
        ids = [(coder.encode(t) if t else b"") + end for t in batch.column("text").to_pylist()]
        n = np.array([len(x) for x in ids], np.int64) // coder.wide.itemsize
        task = TaskContext.get()
        here = (task.stageId(), task.partitionId(), task.taskAttemptId())
        base = state.get(here, 0)
        state.clear()
        state[here] = base + int(n.sum())
        size = len(ids)
        return {"doc_id": batch.column("doc_id"), "part": np.full(size, task.partitionId()), "before": base + np.cumsum(n) - n, "n": n, "wide": np.full(size, coder.wide.itemsize, np.int32), "ids": ids}

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, part long, before long, n long, wide int, ids binary", step)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, ids: bool = False) -> DataFrame:
    """One row per piece (`PIECES`); with ids also the token ids of the piece as an array."""
    spark = ready(docs.sparkSession)
    tokens = written(encoded(docs, tokenizer, end_id), "tokens")
    # One row for each partition of pass one: as many as that job had tasks, 16 bytes each.
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n")).collect())
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases or [(0, 0)], "part long, base long")
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "wide", "ids")

    def step(batch):
        out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        for doc_id, at, n, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "wide", "ids")), strict=True):
            all_ids = np.frombuffer(raw, f"<u{wide}").astype("<u4")
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, length)
                size = min(n - start, length - offset)
                piece = all_ids[start : start + size]
                for k, v in (("doc_id", doc_id), ("start", start), ("length", size), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", n), ("sequence_id", sequence), ("offset", offset)):
                    out[k].append(v)
                out["ids"].append(piece.astype(np.int64) if ids else None)
                start += size
        return out

    return in_batches(placed, PIECES + (", ids array<long>" if ids else ""), step)
