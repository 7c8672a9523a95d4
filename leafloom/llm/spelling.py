"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted or deleted character changes one letter count by one, a replaced one changes two: squared distance 1 between words of adjacent
lengths, 2 between words of one length. Words are dealt into blocks by their letter counts summed over `GROUPS` groups of letters (their sum is the
length, so every block has one length), and a near word can only lie in the same block or in one that differs by one in one group, or
by one up and one down in two. Each block meets those blocks, each pair of blocks once. A block of more than `TILE` words is cut by hash into
tiles, and pairs of tiles are dealt to tasks. A task multiplies the count matrices of its two tiles, keeps the pairs of the two distances,
compares their letters, and emits per word how many near words it found and the best of them, so pairs never leave a task.

Forms are followed to their end by doubling. A form has at least ten times the occurrences, so chains are as long as the
number of digits of the largest count at most, and the number of rounds follows from that.

Input: null texts have no words. Rows that repeat an id count each, rows without an id hash as the id ''. Words longer than any limit stay whole: tiles
of long words hold fewer of them. Equal counts: the form is the least word in code-point order. An empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import ready, written

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED = 31
SHORTEST, FEWEST, RATIO = 7, 2, 10
#: Letters by group, so that each holds about an equal share of usual text; letters that are not named here share the last one.
GROUPS = ("eqz", "tivk", "anwxj", "ohcgp", "rsdb")
TILE = 2_000
TILE_BYTES = 4_000_000
LETTER_KINDS = 26 + 64  # a-z, U+00C0 to U+00FF
PLACE = np.zeros(256, np.int64)
PLACE[ord("a") : ord("z") + 1], PLACE[0xC0:] = np.arange(26), np.arange(26, 90)
EXACT = 1_000  # letters up to which squared counts, and sums of two of them, are whole numbers of single precision


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id and every run of letters, A-Z in lower case; a run with one in `DAMAGED` lacks a letter afterwards. Shorter ones go."""
    text = F.translate("text", UPPER, LOWER)
    every = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    long = every.where(F.length("run") >= shortest).select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    whole, cut = F.col("run"), F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring("run", at + 2, F.length("run")))
    return long.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(whole).alias("word")).where(F.length("word") >= shortest)


def words(docs: DataFrame) -> DataFrame:
    """word and n of the words that occur often enough."""
    return runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)


def group_counts() -> list[Column]:
    """How many letters of a word each group has; the last one has the rest."""
    named = [(F.length("word") - F.length(F.translate("word", letters, ""))).cast("int") for letters in GROUPS]
    rest = F.length(F.translate("word", "".join(GROUPS), "")).cast("int")
    return [*named, rest]


def steps_up() -> list[list[int]]:
    """Differences of the blocks that a block meets, so that each pair of blocks is met from one side: itself, one letter more, one letter moved to a later group."""
    size = len(GROUPS) + 1
    unit = [[int(i == g) for i in range(size)] for g in range(size)]
    moved = [[b - a for a, b in zip(unit[g], unit[h], strict=True)] for g, h in permutations(range(size), 2) if g < h]
    return [[0] * size, *unit, *moved]


def tiles(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, n, block (a number), tile (within its block); and the blocks: block, letters (its counts), tiles."""
    keyed = vocabulary.withColumn("letters", F.array(*group_counts()))
    length = F.aggregate("letters", F.lit(0), lambda s, x: s + x)
    most = F.greatest(F.lit(1), F.least(F.lit(TILE), (TILE_BYTES / length).cast("int")))
    blocks = keyed.groupBy("letters").agg(F.count("*").alias("size"))
    blocks = written(blocks.select(F.monotonically_increasing_id().alias("block"), "letters", F.ceil(F.col("size") / most).cast("int").alias("tiles")), "blocks")
    return keyed.join(blocks, "letters").select("word", "n", "block", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("tile"), "tiles"), blocks


PAIR = ["low", "low_tile", "high", "high_tile"]


def meetings(dealt: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per word and pair of tiles it takes part in: `PAIR`, right (which side), word, n.

    The word's own block gives pairs of tiles (i <= j); a block above gives tile i of the lower with tile j of the upper. The number of tiles
    of the other block comes by a join of blocks, which only has pairs of blocks that exist.
    """
    up = blocks.select("block", "tiles", "letters", F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps_up()])).alias("step"))
    up = up.select("block", "tiles", F.zip_with("letters", "step", lambda a, b: a + b).alias("letters"))
    met = up.join(blocks.select("letters", F.col("block").alias("above"), F.col("tiles").alias("above_tiles")), "letters")
    side = lambda own, right, other, others: met.select(F.col(own).alias("block"), F.struct(F.lit(right).alias("right"), F.col(other).alias("other"), F.col(others).alias("others")).alias("m"))
    both = side("block", False, "above", "above_tiles").union(side("above", True, "block", "tiles").where("block != m.other"))
    both = both.groupBy("block").agg(F.collect_list("m").alias("meets"))  # at most one per step and direction
    each = dealt.join(both, "block").select("word", "n", "block", "tile", F.explode("meets").alias("m"))
    each = each.select("word", "n", "block", "tile", "m.right", "m.other", F.explode(F.sequence(F.lit(0), F.col("m.others") - 1)).alias("facing"))
    same = F.col("block") == F.col("other")
    swapped = (same & (F.col("facing") < F.col("tile"))) | F.col("right")  # within a block the lower tile is left
    own, other = ("block", "tile"), ("other", "facing")
    key = [F.when(swapped, F.col(theirs)).otherwise(F.col(mine)).alias(name) for name, mine, theirs in zip(PAIR, own + other, other + own, strict=True)]
    return each.select(*key, swapped.alias("right"), "word", "n")


class Words:
    """Rows of pairs of tiles, in order: letters, letter counts and squared lengths of all words at once."""

    def __init__(self, rows: pa.Table):
        self.words = rows.column("word").to_pylist()
        self.n = rows.column("n").to_numpy()
        self.right = rows.column("right").to_numpy(zero_copy_only=False)
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.codes = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8)
        place = np.repeat(np.arange(len(self.words)) * LETTER_KINDS, self.sizes) + PLACE[self.codes]
        exact = np.float32 if self.sizes.max() < EXACT else np.float64
        self.counts = np.bincount(place, minlength=len(self.words) * LETTER_KINDS).reshape(-1, LETTER_KINDS).astype(exact)
        self.norms = (self.counts * self.counts).sum(1)
        keys = [rows.column(c).to_numpy() for c in PAIR]
        new = np.logical_or.reduce([np.diff(k, prepend=k[0] - 1) != 0 for k in keys])
        self.firsts = np.flatnonzero(new)
        self.itself = (keys[0] == keys[2]) & (keys[1] == keys[3])

    def letters(self, start: int, stop: int) -> np.ndarray:
        return self.codes[self.starts[start] : self.starts[stop]].reshape(stop - start, -1)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of near words, each pair in both directions."""
        own, other = [], []
        for start, stop in zip(self.firsts.tolist(), [*self.firsts[1:].tolist(), len(self.words)], strict=True):
            middle = start if self.itself[start] else start + int(np.searchsorted(self.right[start:stop], True))
            if self.itself[start]:
                i, j = self.compare(start, stop, start, stop)
                own.append(i)
                other.append(j)
            elif start < middle < stop:
                i, j = self.compare(start, middle, middle, stop)
                own += [i, j]
                other += [j, i]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(own or none), np.concatenate(other or none)

    def compare(self, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Words a..b with words c..d, which are as long or one letter longer: places of those exactly one edit apart."""
        more = int(self.sizes[c] - self.sizes[a])
        gram = self.counts[a:b] @ self.counts[c:d].T
        gram *= -2
        gram += self.norms[a:b, None]
        gram += self.norms[c:d]
        i, j = np.nonzero(gram == (1 if more else 2))
        if not len(i):
            return i, j
        left, right, keep = self.letters(a, b), self.letters(c, d), []
        size = left.shape[1]
        for at in range(0, len(i), step := max(1, 8_000_000 // size)):
            x, y = left[i[at : at + step]], right[j[at : at + step]]
            if more:  # what agrees from the left and what agrees from the right cover the shorter word
                head = np.logical_and.accumulate(x == y[:, :size], 1).sum(1)
                tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
                keep.append(head + tail >= size)
            else:
                keep.append((x != y).sum(1) == 1)
        keep = np.concatenate(keep)
        return i[keep] + a, j[keep] + c

    def found(self) -> pa.RecordBatch:
        """Per row with near words: how many, and the most frequent of them (ties: the least)."""
        own, other = self.near()
        used, place = np.unique(other, return_inverse=True)
        names = [self.words[k] for k in used.tolist()]
        rank = np.empty(len(used), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((rank[place], -self.n[other], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        columns = [
            pa.array([self.words[k] for k in own[first].tolist()], pa.string()),
            pa.array(np.diff(np.append(first, len(own))), pa.int64()),
            pa.array(self.n[other[first]], pa.int64()),
            pa.array([self.words[k] for k in other[first].tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles come one after the other; the last of a batch waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [rows.column(c).to_numpy() for c in PAIR]
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        if len(last):
            cut = int(last[-1]) + 1
            yield Words(rows.slice(0, cut)).found()
            held = rows.slice(cut).to_batches()
    if held:
        yield Words(pa.Table.from_batches(held)).found()


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, and the best near word (form, form_n) of every word that has one."""
    met = meetings(*tiles(vocabulary))
    found = met.repartition(*PAIR).sortWithinPartitions(*PAIR, "right").mapInArrow(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    spark = ready(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    vocabulary = written(words(docs), "vocabulary")
    full = F.col("form_n") >= RATIO * F.col("n")
    rows = vocabulary.join(near(vocabulary), "word", "left").select("word", F.when(full, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(full, F.col("form_n")).alias("form_n"))
    rows = written(rows, "forms")
    ends = rows.where("form is not null").select("word", F.col("form").alias("root"))
    largest = vocabulary.agg(F.max("n")).first()[0] or 0
    reach = 1
    while RATIO**reach * FEWEST <= largest:  # a chain of reach + 1 forms can exist
        ends = written(ends, "roots")
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
