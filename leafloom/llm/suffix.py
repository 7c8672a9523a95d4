"""Dedup of repeated passages over a sparse set of places.

Only suffixes that start at a minimiser are retained: of the 8-word runs within any window of 50 words, the one with the least hash. Equal windows choose the same
place, so a repeated passage always retains equal suffixes, about one in twenty positions. No suffix array
is built: retained places are grouped by the hash of their first 8 words, and where two agree, the windows that chose them are hashed over all 50 words
and grouped again, so results are those of sorting and extension up to equal 64-bit hashes. Neighbouring windows make one passage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import one_row_per_id, window_hashes
from leafloom.llm.windows import Repeats, covered, without

RUN = 8


def minimisers(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its least run of 8 words (the first of equal ones), and the hashes of all runs."""
    keys = window_hashes(h, min(RUN, width))
    span = width - min(RUN, width) + 1
    if len(keys) < span:
        return np.empty(0, np.int64), keys
    out = np.empty(len(keys) - span + 1, np.int64)
    for lo in range(0, len(out), 100_000):  # bounded memory for very long texts
        view = np.lib.stride_tricks.sliding_window_view(keys[lo : lo + 100_000 + span - 1], span)
        out[lo : lo + len(view)] = view.argmin(axis=1) + np.arange(lo, lo + len(view))
    return out, keys


def sparse_suffixes(width: int):
    def anchors(h: np.ndarray):
        chosen, keys = minimisers(h, width)
        at = np.unique(chosen)
        return at, keys[at]

    def spoken_for(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.isin(minimisers(h, width)[0], at)

    return anchors, spoken_for


def passages(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, start, n_removed (words), first_doc_id, first_start: every passage of `width` words or more that also stands earlier.

    A passage is a run of repeated windows, cut where the earlier place changes. It names words from the first one that no passage before it has
    named, so words count once. Takes one row per id. Null and short texts have none; an empty table gives no rows.
    """
    repeats = Repeats(docs, width, *sparse_suffixes(width), sources=True)

    def finish(doc, raw, starts, docs_, ats):
        if not len(starts):
            return []
        cut = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (np.diff(docs_) != 0) | (np.diff(ats) != 1)))
        rows, done = [], 0
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(starts)).tolist(), strict=True):
            begin, end = max(int(starts[i]), done), int(starts[j - 1]) + width
            if end > begin:
                rows.append((doc, begin, end - begin, int(docs_[i]), int(ats[i]) + begin - int(starts[i])))
            done = max(done, end)
        return rows

    return repeats.each(finish, "doc_id long, start long, n_removed long, first_doc_id long, first_start long")


def remove_passages(docs: DataFrame, width: int = 50) -> DataFrame:
    """All columns of the documents, the text without the words of `passages`; documents without any stay as they are.

    Rows without an id stay as they are too; of rows that repeat an id one is kept.
    """
    named = [c for c in docs.columns if c != "doc_id"]
    unnamed = docs.where(F.col("doc_id").isNull())
    docs = one_row_per_id(docs, *named)
    repeats = Repeats(docs, width, *sparse_suffixes(width))

    def finish(doc, raw, starts):
        return [(doc, without(raw, covered(starts, width, len(raw.split()))))] if len(starts) else []

    changed = repeats.each(finish, "doc_id long, clean string")
    joined = docs.join(changed, "doc_id", "left").withColumn("text", F.coalesce("clean", "text"))
    if "n_chars" in named:
        joined = joined.withColumn("n_chars", F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select("doc_id", *named).unionByName(unnamed)
