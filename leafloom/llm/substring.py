"""Substring dedup with difference-cover anchors.

Positions modulo 13 in {0, 1, 3, 9} are a difference cover: whatever the places i and j of two equal stretches, some shift below 13 brings
both onto cover positions. So of two equal windows of 20 words, one 8-word anchor at a cover position lies at the same place in both; only
4 of 13 positions are hashed. Windows that hold a repeated anchor are then compared on all their words, exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from leafloom.llm.common import window_hashes
from leafloom.llm.windows import Repeats, covered, without

PERIOD, COVER = 13, np.array([0, 1, 3, 9])


def cover_anchors(width: int, period: int = PERIOD, cover: np.ndarray = COVER):
    """Anchors at cover positions, and the windows of `width` words for which repeated ones speak."""
    if width < period:
        raise ValueError(f"a window needs {period} words at least")
    size = width - period + 1

    def anchors(h: np.ndarray):
        keys = window_hashes(h, size)
        if len(h) < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(np.isin(np.arange(len(keys)) % period, cover))
        return at, keys[at]

    def spoken_for(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(h) - width + 2, np.int64)
        np.add.at(edges, np.clip(at - period + 1, 0, len(edges) - 1), 1)
        np.add.at(edges, np.clip(at + 1, 0, len(edges) - 1), -1)
        return np.cumsum(edges[:-1]) > 0

    return anchors, spoken_for


def remove_repeats(docs: DataFrame, width: int = 20, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), with text also the text that is left.

    A word goes if a window of `width` words over it also starts earlier (least document, then position). Takes one row per id. Null texts, and texts
    of fewer words than a window, lose nothing. An empty table gives no rows.
    """
    repeats = Repeats(docs, width, *cover_anchors(width))

    def finish(doc, raw, starts):
        words = (raw or b"").split()
        remove = covered(starts, width, len(words))
        kept = words if not len(starts) else [w for w, gone in zip(words, remove.tolist(), strict=True) if not gone]
        row = (doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
        if text:
            row += (None if raw is None else without(raw, remove) if len(starts) else raw.decode(),)
        return [row]

    return repeats.each(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if text else ""))
