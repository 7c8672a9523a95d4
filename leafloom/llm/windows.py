"""Exact repeats of fixed windows of words, for operators that find them through anchors.

Documents are dealt into parts, hashes into shards; both counts grow with the table, so the memory a part or shard needs does not.
What travels are packed columns (hash, document, position), compressed. Three passes over the texts:

1. `repeated_anchors`: the operator's anchors of all documents, by hash. The positions of those that occur twice go back to their part.
2. `repeated_windows`: windows that an anchor found twice speaks for, by the hash of all their words. Every one but the first (least
   document, then position) is a repeat.
3. `with_repeats`: each document with the starts of its repeated windows.

Hashes have 64 bits; equal ones count as equal words. Before anything is sent, a task or part keeps one of equal hashes and
answers the others itself, so a passage of a third of all documents is a row per task in its shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import arrow_schema, mix, one_row_per_id, ready, shard_count, word_hashes, written

PACKED = "kind int, shard long, packed binary"
ENTRIES, ANSWERS = 0, 1
FLUSH = 1_500_000


def pack(columns: list[np.ndarray]) -> bytes:
    """64-bit columns of one length; the second and later ones as differences, which compress well."""
    import zstandard

    first, *rest = columns
    raw = first.tobytes() + b"".join(np.diff(c.astype(np.int64), prepend=0).tobytes() for c in rest)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blobs: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    import zstandard

    out: list[list] = [[] for _ in range(columns)]
    for blob in blobs:
        table = np.frombuffer(zstandard.decompress(blob.as_py()), np.int64).reshape(columns, -1)
        out[0].append(table[0])
        for i in range(1, columns):
            out[i].append(np.cumsum(table[i]))
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def dealt(kind: int, shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One packed row for each shard."""
    if not len(shard):
        return []
    by = np.argsort(shard, kind="stable")
    shard, columns = shard[by], [c[by] for c in columns]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return [(kind, int(shard[i]), pack([c[i:j] for c in columns])) for i, j in zip(cuts, np.append(cuts[1:], len(shard)), strict=True)]


def rows_table(rows: list[tuple[int, int, bytes]], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def by_hash(h: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """Order by hash, document, position; marks of the first of each hash, and its count."""
    by = np.lexsort((at, doc, h))
    h, doc, at = h[by], doc[by], at[by]
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    cuts = np.flatnonzero(first)
    return h, doc, at, first, np.diff(np.append(cuts, len(h)))


def texts_of(table: pa.Table):
    for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
        yield doc, word_hashes((text or "").encode())


def repeated_anchors(docs: DataFrame, anchors: Callable, parts: int, shards: int) -> DataFrame:
    """Answers by part: document and position of every anchor whose hash occurs more than once in the table.

    `anchors` takes the word hashes of a document and gives positions and hashes.
    """
    schema = arrow_schema(PACKED)

    def run(batches):
        held: list = []

        def flush():
            h, doc, at, first, n = by_hash(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            again = np.repeat(n > 1, n)
            # An entry tells with its last column that it needs no answer but counts twice.
            entries = dealt(ENTRIES, (mix(h[first]) % np.uint64(shards)).astype(np.int64), [h[first].view(np.int64), doc[first], at[first], (n > 1).astype(np.int64)])
            return rows_table(entries + dealt(ANSWERS, doc[again] % parts, [doc[again], at[again]]), schema).to_batches()

        size = 0
        for batch in batches:
            for doc, h in texts_of(batch):
                at, keys = anchors(h)
                held.append((keys, np.full(len(at), doc, np.int64), at))
                size += len(at)
            if size > FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def step(table: pa.Table) -> pa.Table:
        h, doc, at, known = unpack(table.column("packed"), 4)
        by = np.argsort(h, kind="stable")
        h, doc, at, known = h[by], doc[by], at[by], known[by]
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(cuts, len(h)))
        ask = (np.repeat(n, n) > 1) & (known == 0)
        return rows_table(dealt(ANSWERS, doc[ask] % parts, [doc[ask], at[ask]]), schema)

    packed = written(docs.mapInArrow(run, PACKED), "anchors")
    asked = packed.where(F.col("kind") == ENTRIES).groupBy("shard").applyInArrow(step, PACKED)
    return packed.where(F.col("kind") == ANSWERS).union(asked).select(F.col("shard").alias("part"), "packed")


def marks(packed: pa.ChunkedArray, columns: int) -> dict[int, list[np.ndarray]]:
    """Rows of packed answers by document."""
    doc, *rest = unpack(packed, columns)
    by = np.lexsort((rest[0], doc))
    doc, rest = doc[by], [c[by] for c in rest]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
    return {int(doc[i]): [c[i:j] for c in rest] for i, j in zip(cuts, np.append(cuts[1:], len(doc)), strict=True)} if len(doc) else {}


def repeated_windows(docs: DataFrame, answers: DataFrame, width: int, spoken_for: Callable, parts: int, shards: int, sources: bool) -> DataFrame:
    """Answers by part: document and start of every window whose words also start earlier, with sources the document and start of
    an earlier one too.

    `spoken_for` takes the word hashes and the positions of repeated anchors and marks the window starts to look at.
    """
    schema = arrow_schema(PACKED)

    def ask(docs_table: pa.Table, answers_table: pa.Table) -> pa.Table:
        from leafloom.llm.common import window_hashes

        found, held = marks(answers_table.column("packed"), 2), []
        for doc, h in texts_of(docs_table):
            if doc in found and len(h) >= width:
                at = np.flatnonzero(spoken_for(h, found[doc][0]))
                held.append((window_hashes(h, width)[at], np.full(len(at), doc, np.int64), at))
        if not held:
            return rows_table([], schema)
        h, doc, at, first, n = by_hash(*(np.concatenate(c) for c in zip(*held, strict=True)))
        entries = dealt(ENTRIES, (mix(h[first]) % np.uint64(shards)).astype(np.int64), [h[first].view(np.int64), doc[first], at[first]])
        origin = np.repeat(np.flatnonzero(first), n)[~first]
        own = [doc[~first], at[~first], *([doc[origin], at[origin]] if sources else [])]
        return rows_table(entries + dealt(ANSWERS, own[0] % parts, own), schema)

    def step(table: pa.Table) -> pa.Table:
        h, doc, at, first, n = by_hash(*unpack(table.column("packed"), 3))
        origin = np.repeat(np.flatnonzero(first), n)[~first]
        own = [doc[~first], at[~first], *([doc[origin], at[origin]] if sources else [])]
        return rows_table(dealt(ANSWERS, own[0] % parts, own), schema)

    packed = written(docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(ask, PACKED), "windows")
    resolved = packed.where(F.col("kind") == ENTRIES).groupBy("shard").applyInArrow(step, PACKED)
    return packed.where(F.col("kind") == ANSWERS).union(resolved).select(F.col("shard").alias("part"), "packed")


def covered(starts: np.ndarray, width: int, words: int) -> np.ndarray:
    """Marks of the words that windows at these starts cover."""
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, words), -1)
    return np.cumsum(edges[:-1]) > 0


def without(text: bytes, remove: np.ndarray) -> str:
    """The text without the words marked and the white space behind each."""
    import re

    starts = np.array([m.start() for m in re.finditer(rb"[^ \t-\r]+", text)], np.int64)
    ends = np.append(starts[1:], len(text))
    keep = np.ones(len(text), bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], remove.astype(np.int8), [0]))))
    for i, j in edges.reshape(-1, 2):
        keep[starts[i] : ends[j - 1]] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes().decode()


class Repeats:
    """The three passes over one table of documents."""

    def __init__(self, docs: DataFrame, width: int, anchors: Callable, spoken_for: Callable, sources: bool = False):
        spark = ready(docs.sparkSession)
        plain = one_row_per_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text")
        rows = plain.count()
        self.parts, self.shards = prime_from(shard_count(spark, rows, 2_000)), shard_count(spark, rows, 2_500)
        self.width, self.sources = width, sources
        self.docs = plain.withColumn("part", F.pmod("doc_id", F.lit(self.parts)))
        answers = written(repeated_anchors(plain, anchors, self.parts, self.shards), "repeated")
        self.answers = written(repeated_windows(self.docs, answers, width, spoken_for, self.parts, self.shards, sources), "repeats")

    def each(self, finish: Callable, schema: str) -> DataFrame:
        """`finish` takes a document's id, text (bytes, None if null), the starts of its repeated windows, and with sources the
        documents and starts they repeat; it gives a list of rows."""
        target, columns, sources = arrow_schema(schema), 4 if self.sources else 2, self.sources

        def run(docs_table: pa.Table, answers_table: pa.Table) -> pa.Table:
            found, rows = marks(answers_table.column("packed"), columns), []
            none = [np.empty(0, np.int64)] * (columns - 1)
            if sources:  # what repeats a window of the same part repeats what that one repeats
                first = {(d, a): (sd, sa) for d, (at, docs_, ats) in found.items() for a, sd, sa in zip(at.tolist(), docs_.tolist(), ats.tolist(), strict=True)}
                for own in found.values():
                    ends = [(d, a) for d, a in zip(own[1].tolist(), own[2].tolist(), strict=True)]
                    ends = [first.get(e, e) for e in ends]
                    own[1], own[2] = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
            for doc, text in zip(docs_table.column("doc_id").to_pylist(), docs_table.column("text").to_pylist(), strict=True):
                rows += finish(doc, None if text is None else text.encode(), *found.get(doc, none))
            return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(target)], schema=target)

        return self.docs.groupBy("part").cogroup(self.answers.groupBy("part")).applyInArrow(run, schema)
