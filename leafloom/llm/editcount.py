"""Token counts that follow edits.

The pre-tokens of a byte-level vocabulary never reach from other characters into white space behind them. So a text can be cut wherever white space
follows something else, and the parts encoded by themselves give the same ids as the whole. Each document keeps a segment tree over such parts of some
hundred characters: heaps of character lengths and token counts, leaves in the second half. An edit is located by descending the lengths; the leaves it touches
are encoded anew, together with the neighbour wherever the cut between them is no longer one; then the sums above are updated. What isn't touched is
never encoded again.

Null texts count as empty. Rows are counted one by one, whatever their ids. Edits have code-point offsets of the text before any of them; of edits
that overlap one before, and edits out of bounds, the part inside the text and behind that one counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import in_batches, ready
from leafloom.llm.packing import byte_level

CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
LEAF = 400
EDIT = "array<struct<start: int, end: int, text: string>>"


class Tree:
    """Lengths and token counts of the parts of a text, with their sums above them."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        self.text, self.count, self.leaf, self.recoded = text, count, leaf, 0
        self._build()

    def _build(self):
        parts, start = [], 0
        for m in CUT.finditer(self.text):
            if m.start() - start >= self.leaf:
                parts.append(self.text[start : m.start()])
                start = m.start()
        parts.append(self.text[start:])
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        self.lengths, self.counts = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, part in enumerate(parts):
            self.lengths[self.size + i], self.counts[self.size + i] = len(part), self.count(part)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i):
        self.lengths[i] = self.lengths[2 * i] + self.lengths[2 * i + 1]
        self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.counts[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with a character (the last one that isn't empty for the end of the text), and the offset of its first."""
        node, start = 1, 0
        at = min(at, max(self.lengths[1] - 1, 0))
        while node < self.size:
            node *= 2
            if at - start >= self.lengths[node]:
                start += self.lengths[node]
                node += 1
        return node, start

    def _whole(self, first: int, last: int, begin: int, end: int, text: str) -> tuple[int, int, int, int]:
        """Leaves and offsets widened until the new text between them begins and ends at cuts. `text` is what will be there."""
        while True:
            body = text[begin : len(text) - (self.lengths[1] - end)]
            rest = self.lengths[1] - end
            if first > self.size and begin > 0 and not (body and CUT.match(text, begin)):
                first -= 1
                begin -= self.lengths[first]
            elif last < 2 * self.size - 1 and rest > 0 and not (body and CUT.match(text, len(text) - rest)):
                last += 1
                end += self.lengths[last]
            else:
                return first, last, begin, end

    def edit(self, start: int, end: int, new: str) -> None:
        first, begin = self._find(start)
        last, stop = self._find(max(start, end - 1))
        stop += self.lengths[last]
        text = self.text[:start] + new + self.text[end:]
        first, last, begin, stop = self._whole(first, last, begin, stop, text)
        body = text[begin : len(text) - (self.lengths[1] - stop)]
        self.text = text
        if len(body) > 8 * self.leaf and len(body) > 2 * (stop - begin):  # a leaf that grew out of shape: cut anew
            self.recoded += len(text)
            self._build()
            return
        self.recoded += len(body)
        self.lengths[first], self.counts[first] = len(body), self.count(body)
        for i in range(first + 1, last + 1):
            self.lengths[i] = self.counts[i] = 0
        low, high = first, last
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._sum(i)


def in_order(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits that don't overlap, from the first to the last."""
    out, done = [], 0
    for start, end, new in sorted((e["start"] or 0, e["end"] or 0, e["text"] or "") for e in edits or [] if e):
        start = min(max(start, done), size)
        end = min(max(end, start), size)
        out.append((start, end, new))
        done = end
    return out


def recount(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_chars, n_recoded_chars for rows of doc_id, text, edits (`EDIT`)."""
    ready(rows.sparkSession)

    def step(batch):
        coder = byte_level(tokenizer)
        count = lambda part: len(coder.ids(part)) if part else 0
        out: dict = {k: [] for k in ("n_tokens", "n_edits", "n_tokens_after", "n_chars", "n_recoded_chars")}
        for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
            tree = Tree(text or "", count)
            before, todo = tree.tokens, in_order(edits, len(text or ""))
            for start, end, new in reversed(todo):  # offsets before an edit stay as they are
                tree.edit(start, end, new)
            for k, v in zip(out, (before, len(todo), tree.tokens, len(text or ""), tree.recoded), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(EDIT))
    return in_batches(rows, "doc_id long, n_tokens long, n_edits int, n_tokens_after long, n_chars long, n_recoded_chars long", step)


#: Mail addresses, long numbers, and what replaces them.
PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ()./-]{5,}\d")
MASK = "[removed]"


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: personal data is masked, and lines that repeat the line right before them are deleted."""

    def step(batch):
        out = []
        for text in batch.column("text").to_pylist():
            text, own, at, last = text or "", [], 0, None
            for line in text.split("\n"):
                if line == last and line:
                    own.append({"start": at - 1, "end": at + len(line), "text": ""})
                else:
                    own += [{"start": at + m.start(), "end": at + m.end(), "text": MASK} for m in PRIVATE.finditer(line)]
                at, last = at + len(line) + 1, line
            out.append(own)
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "edits": out}

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"doc_id long, text string, edits {EDIT}", step)
