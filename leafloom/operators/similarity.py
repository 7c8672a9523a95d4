"""Leaf vectors and pairs of similar leaves.

Leaves ``(ord, subject, node_id, title, body, is_new)``. Leaves with equal signature text have equal vectors,
so vectors and pairs are per distinct signature, with the number of leaves behind it: a group of copies
counts as one vertex however large it is.
"""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.functions import vectors as V
from leafloom.session import broadcast_when_small, cut_lineage, stored

DIGITS = 6
SLACK = 1e-6
PAIRS_PER_TASK = 1 << 20
#: Below so many meetings on head slots, or if one pair of vectors in so many meets, pairs are found by meeting; else by products of blocks.
FEW_MEETINGS, MEETING_COST = 1 << 20, 16
#: Columns of a folded vector, rows of a block, most blocks of a cell's side, and more than the error of a product in single precision.
FOLD, BLOCK, CELL_BLOCKS, FOLD_SLACK = 1024, 1024, 16, 1e-4
#: A cosine this far below another can't be the same when rounded, and so many pairs that may be best are held until the worse ones go.
ROUNDED, HELD_PAIRS = 1.1 * 10.0**-DIGITS, 1 << 17
#: Columns of a pair whose cosine is known.
PAIR = ["subject", "new_sig", "n_new", "new_node", "new_ord", "existing_sig", "n_existing", "existing_node", "existing_ord", "_cosine"]
Embedder = Callable[[DataFrame], DataFrame]


def with_signature(leaves: DataFrame, keep_headings: bool = False) -> DataFrame:
    """Adds ``signature`` and its key ``sig``. Source headings are dropped first, so that a stored body
    and a fresh one compare alike."""
    body = F.col("body") if keep_headings else T.strip_source_headings(F.col("body"))
    rows = leaves.withColumn("signature", V.embed_signature(F.col("title"), body))
    return rows.withColumn("sig", F.md5("signature"))


def signature_groups(signed: DataFrame) -> DataFrame:
    """One row per subject, side and signature: size, text, and the first leaf in tree order."""
    return signed.groupBy("subject", "is_new", "sig").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ord").alias("first_ord"),
        F.min_by("node_id", "ord").alias("first_node"),
        F.first("signature").alias("signature"),
    )


def hash_embedder(dim: int = K.EMBED_DIM) -> Embedder:
    """Hashed bag of words: ``(keys, text)``, a row per key, to unit weights ``(keys, slot, weight)``. Each vector is made within its row."""
    if dim < K.MIN_EMBED_DIM:
        raise ValueError(f"dim must be at least {K.MIN_EMBED_DIM}")

    def embed(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "text"]
        slots = F.transform(T.tokens(F.col("text"), K.EMBED_WORD), lambda t: V.token_slot(t, dim))
        # The outer explode keeps Spark from inferring a filter that would make every vector a second time.
        return rows.select(*keys, F.explode_outer(V.unit_weights(slots)).alias("_e")).filter(F.col("_e").isNotNull()).select(*keys, "_e.slot", "_e.weight")

    return embed


def ranked_entries(vectors: DataFrame, threshold: float) -> DataFrame:
    """Vector entries with their place in the subject's order of slots, rarest first.

    ``tail`` is the squared length of the vector from the entry on. Once it is below the squared threshold,
    the rest cannot reach the threshold alone; the entries before are the ``head``, and a partner of cosine >=
    threshold must share a slot of it. ``level`` is a coarse place, the same for slots of like frequency.
    """
    rarity = vectors.groupBy("subject", "slot").agg(F.count(F.lit(1)).alias("df"))
    square = F.col("weight") * F.col("weight")
    vector = Window.partitionBy("is_new", "vec").orderBy(F.desc("df"), F.desc("slot"))
    return vectors.join(rarity, ["subject", "slot"]).withColumns(
        {
            "level": F.floor(4 * F.log2("df")).cast("int"),
            "tail": F.sum(square).over(vector.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).withColumn("head", F.col("tail") >= (threshold - SLACK) ** 2)


def _outlines(entries: DataFrame) -> DataFrame:
    """Per vector: where its head ends, the length after it, and the length from each level on."""
    square = F.col("weight") * F.col("weight")
    longest = entries.groupBy("is_new", "vec", "level").agg(
        F.max("tail").alias("tail"),
        F.max(F.when(F.col("head"), F.struct("df", "slot", "level"))).alias("end"),
        F.min(F.when(F.col("head"), F.col("tail") - square)).alias("rest"),
    )
    tails = F.array_sort(F.collect_list(F.struct("level", F.sqrt("tail").alias("tail"))))
    return longest.groupBy("is_new", "vec").agg(
        F.max("end").alias("end"), F.sqrt(F.greatest(F.lit(0.0), F.min("rest"))).alias("rest"), tails.alias("tails")
    )


def _length_from(tails: Column, level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(tails, lambda x: x["level"] >= level), F.lit(1))["tail"], F.lit(0.0))


def similar_signatures(groups: DataFrame, vectors: DataFrame, threshold: float = K.GREY_SIMILARITY, best: bool = False) -> DataFrame:
    """Every pair (new, existing) of signatures of one subject with cosine >= threshold, exactly; with a threshold of 0 those with a cosine above 0.

    With ``best`` some pairs may be left out for which the new signature has another that is at least as similar and comes no later in tree order.

    ``vectors`` is ``(subject, is_new, vec, slot, weight)``, where ``vec`` is the number of the signature
    group: a short key for the many candidate rows. Candidates come from shared rare slots where these are rare
    enough, else from products of blocks of vectors; their full vectors are compared.
    """
    vectors = stored(vectors.filter(F.col("subject").isNotNull()), "vectors")
    sides = vectors.select("subject", "is_new", "vec").distinct().groupBy("subject").agg(F.count_if("is_new").alias("_n"), F.count_if(~F.col("is_new")).alias("_m"))
    sides = cut_lineage(sides.filter("_n > 0 AND _m > 0"))
    pairs = sides.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    few = max(FEW_MEETINGS, pairs / MEETING_COST)
    candidates = _meeting_pairs(vectors, threshold) if pairs <= few or _meetings(vectors, sides, threshold) <= few else _block_pairs(groups, vectors, sides, pairs, threshold, best)
    if "_cosine" in candidates.columns:
        return candidates.filter("_cosine > 0").withColumn("similarity", F.round("_cosine", DIGITS)).filter(F.col("similarity") >= threshold).drop("_cosine")
    entry = F.array_sort(F.collect_list(F.struct("slot", "weight")))
    whole = groups.drop("signature").join(vectors.groupBy("is_new", "vec").agg(entry.alias("v")), ["is_new", "vec"])
    pick = lambda new, tag: whole.filter(F.col("is_new") == F.lit(new)).select(
        *(["subject"] if new else []),
        F.col("vec").alias(f"_{tag}_vec"),
        F.col("sig").alias(f"{tag}_sig"),
        F.col("n").alias(f"n_{tag}"),
        F.col("first_node").alias(f"{tag}_node"),
        F.col("first_ord").alias(f"{tag}_ord"),
        F.col("v").alias(f"_v{tag}"),
    )
    pairs = candidates.join(pick(True, "new"), "_new_vec").join(pick(False, "existing"), "_existing_vec")
    scored = pairs.withColumn("_cosine", sparse_dot(F.col("_vnew"), F.col("_vexisting"))).withColumn("similarity", F.round("_cosine", DIGITS))
    scored = (scored if threshold > 0 else scored.filter("_cosine > 0")).drop("_cosine")
    return scored.filter(F.col("similarity") >= threshold).drop("_vnew", "_vexisting", "_new_vec", "_existing_vec")


def _meetings(vectors: DataFrame, sides: DataFrame, threshold: float) -> float:
    """About how many pairs meet on head slots, from the heads of some new vectors. Only the way to the candidates hangs on it, never the result."""
    share = max(1, (sides.agg(F.sum("_n")).first()[0] or 0) // 2000)
    counts = vectors.groupBy("subject", "slot").agg(F.count(F.lit(1)).alias("df"), F.count_if(~F.col("is_new")).alias("_m"))
    some = vectors.filter(F.col("is_new") & (F.pmod(F.xxhash64("vec"), F.lit(share)) == 0)).join(counts, ["subject", "slot"])
    tail = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("vec").orderBy(F.desc("df"), F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0))
    met = some.withColumn("_tail", tail).filter(F.col("_tail") >= (threshold - SLACK) ** 2).agg(F.sum(F.col("_m").cast("double"))).first()[0]
    return (met or 0.0) * share


def _block_pairs(groups: DataFrame, vectors: DataFrame, sides: DataFrame, pairs: float, threshold: float, best: bool = False) -> DataFrame:
    """Candidate pairs by products of blocks: the new and the existing vectors of a subject are dealt into stripes, and a cell compares two of these.

    Slots are folded into a fixed number of columns of absolute weights, so that a product is never below the cosine. Slots that need no
    folding give the cosine itself, as ``_cosine`` in double precision. A task holds the new vectors of one cell and reads the existing ones
    past them; only pairs that can reach the threshold leave it. With the cosine a pair is whole: vectors carry what their group shows of itself, so no
    pair is shuffled. If only the best pairs are asked for, few per new vector leave a cell.
    """
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    side = BLOCK * min(CELL_BLOCKS, max(1, math.ceil(math.sqrt(pairs / tasks) / BLOCK)))
    grid = sides.select("subject", F.ceil(F.col("_n") / side).cast("int").alias("_rows"), F.ceil(F.col("_m") / side).cast("int").alias("_columns"))
    cells = grid.agg(F.sum(F.col("_rows").cast("long") * F.col("_columns"))).first()[0]
    slot, exact = F.xxhash64("slot"), False
    if dict(vectors.dtypes)["slot"] in ("int", "bigint"):
        slot, range_ = F.col("slot"), vectors.agg(F.min("slot"), F.max("slot"), F.min("weight")).first()
        exact = range_[0] >= 0 and range_[1] < FOLD and range_[2] >= 0
    whole = vectors.groupBy("subject", "is_new", "vec").agg(
        F.collect_list(F.struct(F.pmod(slot, F.lit(FOLD)).cast("short").alias("s"), F.abs("weight").cast("double").alias("w"))).alias("_v")
    )
    whole = whole.select("subject", "is_new", "vec", F.col("_v.s").alias("_slots"), F.col("_v.w").alias("_weights")).join(broadcast_when_small(grid), "subject")
    leaf = F.struct("sig", "n", F.col("first_node").alias("node"), F.col("first_ord").alias("ord"))
    if exact:
        whole = whole.join(groups.select("is_new", "vec", leaf.alias("_leaf")), ["is_new", "vec"])
    own = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = whole.withColumn("_row", F.explode(F.when(F.col("is_new"), F.array(own("_rows"))).otherwise(every("_rows"))))
    dealt = dealt.withColumn("_column", F.explode(F.when(F.col("is_new"), every("_columns")).otherwise(F.array(own("_columns")))))
    rows = dealt.select(F.concat_ws("/", "_row", "_column", "subject").alias("_cell"), (~F.col("is_new")).alias("_old"), "vec", "_slots", "_weights", *(["subject", "_leaf"] if exact else []))
    rows = rows.repartition(int(min(cells, 64 * tasks)), "_cell").sortWithinPartitions("_cell", "_old")
    if not exact:
        return rows.mapInArrow(_products(threshold, exact), "_new_vec long, _existing_vec long")
    shown = [f.dataType for f in rows.schema["_leaf"].dataType]
    kinds = [rows.schema["subject"].dataType, *shown, *shown, DoubleType()]
    return rows.mapInArrow(_products(threshold, exact, best), StructType([StructField(c, kind) for c, kind in zip(PAIR, kinds, strict=True)]))


class _Block:
    """Vectors of one side: numbers or leaves, folded entries, and the matrix of these in single precision."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows.select([c for c in ("subject", "_leaf") if c in rows.schema.names])
        self.vec, slots = rows.column("vec").to_numpy(), rows.column("_slots")
        lengths = slots.value_lengths().to_numpy(zero_copy_only=False)
        self.place = np.repeat(np.arange(rows.num_rows) * FOLD, lengths) + slots.flatten().to_numpy()
        self.weight = rows.column("_weights").flatten().to_numpy()
        self.short = self.matrix().astype(np.float32)

    def matrix(self) -> np.ndarray:
        return np.bincount(self.place, self.weight, len(self.vec) * FOLD).reshape(-1, FOLD)


def _blocks(rows: pa.RecordBatch) -> Iterator[_Block]:
    return (_Block(rows.slice(at, BLOCK)) for at in range(0, rows.num_rows, BLOCK))


def _compared(new: list[_Block], old: _Block, least: float, exact: bool) -> Iterator[pa.RecordBatch]:
    long = None
    for block in new:
        i, j = np.nonzero(block.short @ old.short.T >= least)
        if not len(i):
            continue
        if not exact:
            yield pa.RecordBatch.from_arrays([pa.array(block.vec[i]), pa.array(old.vec[j])], names=["_new_vec", "_existing_vec"])
            continue
        mine, long = block.matrix(), old.matrix() if long is None else long
        for at in range(0, len(i), BLOCK):
            a, b = i[at : at + BLOCK], j[at : at + BLOCK]
            left, right = block.rows.take(pa.array(a)), old.rows.take(pa.array(b))
            cosine = pa.array(np.einsum("ij,ij->i", mine[a], long[b]))
            yield pa.RecordBatch.from_arrays([left.column("subject"), *left.column("_leaf").flatten(), *right.column("_leaf").flatten(), cosine], names=PAIR)


class _Best:
    """The pairs of a cell that may be best for their new vector: its highest cosine so far, and pairs that no pair as similar precedes in tree order."""

    def __init__(self, threshold: float):
        self.least, self.blocks, self.kept, self.waiting, self.waits = threshold, [], None, [], 0
        self.top = np.zeros(0)

    def hold(self, blocks: Iterator[_Block]) -> None:
        self.blocks.extend(blocks)
        self.top = np.zeros(sum(len(b.vec) for b in self.blocks))

    def compare(self, old: _Block) -> None:
        start, long = 0, None
        place = old.rows.column("_leaf").field("ord").cast(pa.int64()).fill_null(2**63 - 1).to_numpy()
        for block in self.blocks:
            top = self.top[start : start + len(block.vec)]
            near = block.short @ old.short.T
            # In single precision a pair that shares no slot is 0, and any other above.
            bound = np.maximum(np.maximum(top, near.max(axis=1)), self.least) - FOLD_SLACK
            i, j = np.nonzero(near >= np.maximum(bound, np.finfo(np.float32).tiny)[:, None])
            if len(i):
                mine, long = block.matrix(), old.matrix() if long is None else long
                cosine = np.concatenate([np.einsum("ij,ij->i", mine[i[at : at + BLOCK]], long[j[at : at + BLOCK]]) for at in range(0, len(i), BLOCK)])
                np.maximum.at(top, i, cosine)
                keep = self._first(i, cosine, place[j], top)
                i, j, cosine = i[keep], j[keep], cosine[keep]
                self.waiting.append((i + start, cosine, place[j], old.rows.take(pa.array(j)).column("_leaf")))
                self.waits += len(i)
            start += len(block.vec)
        if self.waits > HELD_PAIRS:
            self._settle()

    @staticmethod
    def _first(i: np.ndarray, cosine: np.ndarray, place: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which pairs may be best: less than the rounding below the highest, and in tree order before all that are as similar."""
        near = np.flatnonzero(cosine >= top[i] - ROUNDED)
        order = near[np.lexsort((place[near], -cosine[near], i[near]))]
        rank = np.unique(place[order], return_inverse=True)[1].astype(np.int64)
        fall = rank - i[order].astype(np.int64) * (len(order) + 1)  # lower for each further new vector than all before
        return order[np.r_[True, fall[1:] < np.minimum.accumulate(fall)[:-1]]] if len(order) else order

    def _settle(self) -> None:
        parts = [*([self.kept] if self.kept else []), *self.waiting]
        i, cosine, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        keep = self._first(i, cosine, place, self.top)
        leaf = pa.concat_arrays([p[3] for p in parts]).take(pa.array(keep))
        self.kept, self.waiting, self.waits = (i[keep], cosine[keep], place[keep], leaf), [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.waiting and not self.kept:
            return
        self._settle()
        i, cosine, _, leaf = self.kept
        start = 0
        for block in self.blocks:
            own = np.flatnonzero((i >= start) & (i < start + len(block.vec)))
            left, right = block.rows.take(pa.array(i[own] - start)), leaf.take(pa.array(own))
            if len(own):
                yield pa.RecordBatch.from_arrays([left.column("subject"), *left.column("_leaf").flatten(), *right.flatten(), pa.array(cosine[own])], names=PAIR)
            start += len(block.vec)


def _products(threshold: float, exact: bool, best: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, found = None, [], _Best(threshold)
        for batch in batches:
            names, old = np.array(batch.column("_cell").to_pylist(), object), batch.column("_old").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (old[1:] != old[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if names[a] != cell:
                    yield from found.rows()
                    cell, held, found = names[a], [], _Best(threshold)
                if not old[a]:
                    blocks = list(_blocks(batch.slice(a, b - a)))
                    held.extend(blocks)
                    found.hold(blocks if best else [])
                    continue
                for block in _blocks(batch.slice(a, b - a)):
                    if best:
                        found.compare(block)
                    else:
                        yield from _compared(held, block, threshold - FOLD_SLACK, exact)
        yield from found.rows()

    return run


def _meeting_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs by head slots.

    Pairs meet on a shared head slot. Up to the end of
    the shorter head all shared slots are counted; what follows is at most the product of the two lengths
    from there on. That bound drops nearly all pairs before full vectors are compared.
    """
    entries = stored(ranked_entries(vectors, threshold), "entries")
    side = lambda new, tag: entries.filter((F.col("is_new") == F.lit(new)) & F.col("head")).select(
        "subject", "slot", F.col("vec").alias(f"_{tag}_vec"), F.col("weight").alias(f"_w{tag}")
    )
    # A slot of many vectors on both sides is dealt out by the new ones, so that no task forms more than a bounded number of pairs.
    sizes = entries.filter("head").groupBy("subject", "slot").agg(F.count_if("is_new").alias("_n"), F.count_if(~F.col("is_new")).alias("_m"))
    dealt = sizes.select("subject", "slot", F.least(F.col("_n"), F.ceil(F.col("_n") * F.col("_m") / PAIRS_PER_TASK)).cast("int").alias("_deals")).filter("_deals > 1")
    dealt = cut_lineage(dealt)
    new, old, on = side(True, "new"), side(False, "existing"), ["subject", "slot"]
    if not dealt.isEmpty():
        dealt, deals, on = broadcast_when_small(dealt), F.coalesce("_deals", F.lit(1)), [*on, "_deal"]
        new = new.join(dealt, ["subject", "slot"], "left").withColumn("_deal", F.pmod(F.xxhash64("_new_vec"), deals).cast("int")).drop("_deals")
        old = old.join(dealt, ["subject", "slot"], "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    shared = new.join(old, on)
    met = shared.groupBy("_new_vec", "_existing_vec").agg(F.sum(F.col("_wnew") * F.col("_wexisting")).alias("_part"))
    outlines = _outlines(entries)
    shape = lambda new, tag: outlines.filter(F.col("is_new") == F.lit(new)).select(
        F.col("vec").alias(f"_{tag}_vec"), *[F.col(c).alias(f"_{tag}_{c}") for c in ("end", "rest", "tails")]
    )
    met = met.join(shape(True, "new"), "_new_vec").join(shape(False, "existing"), "_existing_vec")
    after = F.when(
        F.col("_new_end") <= F.col("_existing_end"),
        F.col("_new_rest") * _length_from(F.col("_existing_tails"), F.col("_new_end.level")),
    ).otherwise(F.col("_existing_rest") * _length_from(F.col("_new_tails"), F.col("_existing_end.level")))
    return met.filter(F.col("_part") + after >= threshold - SLACK).select("_new_vec", "_existing_vec")


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of (slot, weight)."""
    return T.let(
        F.map_from_entries(b),
        lambda other: F.aggregate(
            a, F.lit(0.0), lambda acc, e: acc + e["weight"] * F.coalesce(F.try_element_at(other, e["slot"]), F.lit(0.0))
        ),
    )


def leaf_pairs(leaves: DataFrame, threshold: float = K.GREY_SIMILARITY, embedder: Embedder | None = None, best: bool = False) -> DataFrame:
    """Similar signature pairs of a leaf table with the default or a given embedder; with ``best`` those that may be a new signature's best."""
    # The numbers are fixed by the table.
    groups = stored(signature_groups(with_signature(leaves)).withColumn("vec", F.monotonically_increasing_id()), "signatures")
    texts = groups.select("subject", "is_new", "vec", F.col("signature").alias("text"))
    vectors = (embedder or hash_embedder())(texts)
    return similar_signatures(groups, vectors, threshold, best)


def dense_pairs(rows: DataFrame, block: str, key: str, vector: str, threshold: float) -> DataFrame:
    """Pairs (new, existing) of dense vectors of one block with cosine >= threshold, exactly.

    Two vectors within an angle t differ by at most t in their angle to any pivot. Vectors are put in bins
    of that width by their angle to the block's mean, and each new vector looks into three bins only; two
    more pivots filter what meets there. How much this saves depends on how spread the block is.
    """
    reach = math.acos(threshold) + SLACK
    unit = T.let(V.norm(F.col(vector)), lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))
    units = rows.withColumn("_u", unit)
    parts = units.select(block, F.posexplode("_u").alias("_i", "_x"))
    means = parts.groupBy(block, "_i").agg(F.avg("_x").alias("_x"))
    ordered_mean = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    pivots = means.groupBy(block).agg(F.transform(ordered_mean, lambda p: p["_x"]).alias("_p"))
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    placed = units.join(pivots, block).withColumns(
        {
            "_a": angle(V.cosine(F.col("_u"), F.col("_p"))),
            "_b": angle(F.coalesce(F.try_element_at("_u", F.lit(1)), F.lit(0.0))),
            "_c": angle(F.coalesce(F.try_element_at("_u", F.lit(2)), F.lit(0.0))),
        }
    )
    cell = F.floor(F.col("_a") / reach)
    new = placed.filter("is_new").select(
        block, F.col(key).alias("new_id"), F.col("_u").alias("_un"), F.col("_a").alias("_an"), F.col("_b").alias("_bn"), F.col("_c").alias("_cn"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"),
    )
    old = placed.filter("NOT is_new").select(
        block, F.col(key).alias("existing_id"), F.col("_u").alias("_ue"), F.col("_a").alias("_ae"), F.col("_b").alias("_be"), F.col("_c").alias("_ce"), cell.alias("_cell")
    )
    near = [F.abs(F.col(f"_{p}n") - F.col(f"_{p}e")) <= reach for p in "abc"]
    pairs = new.join(old, [block, "_cell"]).filter(near[0] & near[1] & near[2])
    out = pairs.withColumn("similarity", F.round(V.dot(F.col("_un"), F.col("_ue")), DIGITS))
    return out.filter(F.col("similarity") >= threshold).select(block, "new_id", "existing_id", "similarity")


def sibling_cohesion(rows: DataFrame, parent: str, vector: str) -> DataFrame:
    """Mean cosine among the siblings of a parent, and mean distance of its centroid to the others'.

    The sum over all pairs of unit vectors is (|sum|^2 - n) / 2, so no pair is formed; the same holds for
    centroids.
    """
    unit = T.let(V.norm(F.col(vector)), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    units = rows.filter(V.norm(F.col(vector)) > 0).select(parent, unit.alias("_u"))
    counts = units.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    sums = units.select(parent, F.posexplode("_u").alias("_i", "_x")).groupBy(parent, "_i").agg(F.sum("_x").alias("_s"))
    lengths = sums.groupBy(parent).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"))
    centroids = sums.join(lengths, parent).select(parent, "_i", (F.col("_s") / F.sqrt("_ss")).alias("_c"))
    total = centroids.groupBy("_i").agg(F.sum("_c").alias("_t"))
    to_all = centroids.join(total, "_i").groupBy(parent).agg(F.sum(F.col("_c") * F.col("_t")).alias("_dot"))
    m = counts.agg(F.count(F.lit(1)).alias("_m"))
    n = F.col("n")
    cohesion = F.when(n > 1, (F.col("_ss") - n) / (n * (n - 1)))
    divergence = F.when(F.col("_m") > 1, 1 - (F.col("_dot") - 1) / (F.col("_m") - 1))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(counts.join(lengths, parent).join(to_all, parent)).join(F.broadcast(one(m)), "_one").select(
        parent,
        "n",
        F.round(cohesion, DIGITS).alias("cohesion"),
        F.round(divergence, DIGITS).alias("divergence"),
        (F.coalesce(cohesion, F.lit(1.0)) >= K.SIBLING_COHESION).alias("cohesive"),
        (F.coalesce(divergence, F.lit(1.0)) >= K.PARENT_DIVERGENCE).alias("distinct"),
    )


def similarity_valleys(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Topic boundaries: local minima of the similarity of neighbours, smoothed over five.

    Positions are cut into blocks that overlap by the reach of the window, so a long sequence is spread.
    """
    from leafloom.operators import ordered

    near = ordered.neighbour(rows, [key], order, {"_before": F.col(vector)}, step=-1)
    links = near.filter(F.col("_before").isNotNull()).select(key, order, V.cosine(F.col("_before"), F.col(vector)).alias("similarity"))
    placed = ordered.ordinal(links, [key], order, "_n")
    # Each row is copied to every block whose rows can see it; a copy only serves as a neighbour.
    size, reach = ordered.BLOCK, 3
    home = F.floor(F.col("_n") / size)
    blocks = F.array_distinct(F.array(F.floor((F.col("_n") - reach) / size), home, F.floor((F.col("_n") + reach) / size)))
    copies = placed.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(key, "_block").orderBy("_n")
    smooth = copies.withColumn("smoothed", F.round(F.avg("similarity").over(w.rowsBetween(-2, 2)), DIGITS))
    edges = smooth.withColumns({"_l": F.lag("smoothed").over(w), "_r": F.lead("smoothed").over(w)})
    own = edges.filter(F.col("_home") == F.col("_block"))
    return own.filter((F.col("smoothed") < F.col("_l")) & (F.col("smoothed") <= F.col("_r"))).select(key, order, "smoothed")
