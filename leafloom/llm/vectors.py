"""Near duplicates among embeddings with hierarchical navigable small-world graphs, one per shard.

Vectors are normalised in double precision and dealt into shards by a hash of their id. Every shard builds a graph: nodes have a random level; on each level they
are linked with near nodes chosen for diversity. Every vector is then looked up in every shard: greedy steps down the levels, then a beam on the
lowest one. Two rules widen beams. A beam that ends full of links is doubled for that vector, until its worst entry is no link; from a quarter of
the shard on, the vector is compared with the whole shard. And each shard is audited: a sample of the vectors of all shards
(`AUDITED` at most, by a hash of their id) is compared with all of the shard, and so are vectors planted at the threshold from members, for links can be
too rare to be met by a sample. While the beam finds less than `recall` of the links of either, in sum or in the mean of the vectors that have any, it is
doubled for all. What a vector has with itself is no link: it is left out of the audit, and added without a search.

Links are verified by their cosine in double precision, so none is false. They are reported per vector as a count and the least vector linked in each shard,
and components are the connected ones over links: rows do not grow with the square of a group. Equal vectors are one node with a
weight. Graphs are built and searched with numpy for many vectors at a time.

Vectors that are null, zero, empty, or hold nulls, NaN or infinities link with nothing. Vectors of different lengths are compared only among their own length.
Takes one row per id: rows without an id are left out, of rows that repeat one the least vector counts. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import arrow_schema, ready, written
from leafloom.llm.components import components

SHARD_ROWS = 60_000
LEAST_SHARDS = 6
DEGREE = 12
AUDITED, PLANTED = 2_048, 256
AUDITED_NUMBERS = 1 << 20  # of all sampled vectors together, for they go to every shard


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, seed: int = 7, degree: int = DEGREE, beam: int = 32):
        self.x, self.degree = x, degree
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(degree)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the top levels come first
        self.top = int(level.max()) if n else 0
        self.entry = int(order[0]) if n else -1
        # Neighbours by level: 2 * degree on the lowest, padded with -1.
        self.near = [np.full((n, 2 * degree if k == 0 else degree), -1, np.int32) for k in range(self.top + 1)]
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, 512))]
            self._insert(batch, level, order[:done], beam)
            done += len(batch)

    def _insert(self, batch, level, before, beam):
        starts = np.full(len(batch), self.entry)
        for k in range(self.top, -1, -1):
            here = level[batch] >= k
            ids, sims = self._beam(self.x[batch], starts, k, beam if here.any() else 1)
            starts = ids[:, 0]
            own = batch[here]
            if not len(own):
                continue
            width = self.near[k].shape[1]
            # Candidates: what the beam found, and the others of the batch.
            among = self.x[own] @ self.x[own].T
            np.fill_diagonal(among, -2)
            take = min(width, len(own))
            best = np.argpartition(-among, take - 1, axis=1)[:, :take]
            ids_ = np.concatenate([ids[here], own[best]], axis=1)
            sims_ = np.concatenate([sims[here], np.take_along_axis(among, best, 1)], axis=1)
            ids_ = np.where(sims_ > -2, ids_, -1)
            chosen = self._diverse(ids_, sims_, width // 2)
            self.near[k][own, : chosen.shape[1]] = chosen
            self._link_back(own, chosen, k)

    def _diverse(self, ids, sims, most):
        """Nearest first, without those that are nearer to one taken before than to the node; filled up with the nearest left out."""
        by = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        vectors = self.x[np.maximum(ids, 0)]
        cross = np.einsum("bid,bjd->bij", vectors, vectors)
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            blocked = (taken[:, :j] & (cross[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
            taken[:, j] = ~blocked & (ids[:, j] >= 0) & (taken[:, :j].sum(axis=1) < most)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, rank, 1).astype(np.int32)

    def _link_back(self, own, chosen, k):
        table, width = self.near[k], self.near[k].shape[1]
        sources, targets = np.repeat(own, chosen.shape[1]), chosen.ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        for node, part in zip(*_runs(targets, sources), strict=True):
            old = table[node][table[node] >= 0]
            merged = np.unique(np.concatenate([old, part]))
            merged = merged[merged != node]
            if len(merged) > width:
                sims = self.x[merged] @ self.x[node]
                merged = self._diverse(merged[None], sims[None], width)[0]
            table[node] = -1
            table[node, : len(merged)] = merged

    def _beam(self, queries, starts, k, beam):
        """The `beam` nearest nodes found from the starts, and their similarities, nearest first."""
        q = len(queries)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2.0)
        open_ = np.zeros((q, beam), bool)
        ids[:, 0], open_[:, 0] = starts, True
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.x[starts])
        seen = np.zeros((q, len(self.x)), bool)
        seen[np.arange(q), starts] = True
        live = np.arange(q)
        while len(live):
            at = np.argmax(np.where(open_[live], sims[live], -3), axis=1)
            open_[live, at] = False
            near = self.near[k][ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            found = np.full(near.shape, -2.0)
            found[rows, cols] = np.einsum("nd,nd->n", queries[live[rows]], self.x[near[rows, cols]])
            all_ids, all_sims = np.concatenate([ids[live], np.where(fresh, near, -1)], 1), np.concatenate([sims[live], found], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            by = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, by, 1) for a in (all_ids, all_sims, all_open))
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def nearest(self, queries: np.ndarray, beam: int):
        starts = np.full(len(queries), self.entry)
        for k in range(self.top, 0, -1):
            starts = self._beam(queries, starts, k, 1)[0][:, 0]
        return self._beam(queries, starts, 0, beam)

    def within(self, queries: np.ndarray, threshold: float, beam: int):
        """Pairs (query, node) of at least the threshold. Full beams are widened, and end in a comparison with all nodes."""
        n, out, left = len(self.x), [], np.arange(len(queries))
        while len(left) and beam < n / 4:
            step = max(1, min(256, 8_000_000 // n))
            full = []
            for lo in range(0, len(left), step):
                part = left[lo : lo + step]
                ids, sims = self.nearest(queries[part], beam)
                more = sims[:, -1] >= threshold
                full.append(part[more])
                rows, cols = np.nonzero((sims >= threshold) & ~more[:, None])
                out.append((part[rows], ids[rows, cols]))
            left, beam = np.concatenate(full), beam * 4
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            rows, cols = np.nonzero(queries[part] @ self.x.T >= threshold)
            out.append((part[rows], cols))
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (left, left)


def _runs(keys, values):
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    ends = np.append(cuts[1:], len(keys))
    return keys[cuts], [values[i:j] for i, j in zip(cuts, ends, strict=True)]


def planted(x: np.ndarray, threshold: float, count: int, seed: int = 11) -> np.ndarray:
    """Unit vectors that have a cosine of the threshold with members chosen evenly."""
    chosen = x[np.unique(np.linspace(0, len(x) - 1, min(count, len(x))).astype(int))]
    away = np.random.default_rng(seed).normal(size=chosen.shape)
    away -= np.einsum("nd,nd->n", away, chosen)[:, None] * chosen
    size = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.where(size > 1e-9, away / np.maximum(size, 1e-9), 0)  # vectors of one number have no direction to go
    out = threshold * chosen + np.sqrt(max(0.0, 1 - threshold * threshold)) * away
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def audited_beam(graph: Graph, threshold: float, recall: float, beam: int, node: np.ndarray, sample: np.ndarray, units: np.ndarray, slack: float = 1e-9) -> int:
    """The first of the doubled beams that finds enough of the links of sampled vectors (ids and units, of any shard) and of planted ones."""
    n, kinds = len(graph.x), []
    for ids, queries in ((sample, units), (None, planted(graph.x, threshold, PLANTED))):
        own = np.zeros(0, np.int64) if ids is None else ids
        true = np.zeros(len(queries), np.int64)
        for lo in range(0, len(queries), 256):
            near = queries[lo : lo + 256] @ graph.x.T >= threshold - slack
            if ids is not None:
                near &= own[lo : lo + 256, None] != node[None]
            true[lo : lo + 256] = near.sum(axis=1)
        some = np.flatnonzero(true)
        kinds.append((queries[some], true[some], None if ids is None else own[some]))

    def enough(queries, true, own):
        if not len(true):
            return True
        a, b = graph.within(queries, threshold - slack, beam)
        if own is not None:
            a = a[own[a] != node[b]]
        found = np.bincount(a, minlength=len(true))
        return found.sum() >= recall * true.sum() and (found / true).mean() >= recall

    while beam < n / 4 and not all(enough(*kind) for kind in kinds):
        beam *= 2
    return beam


def own_links(graph: Graph, weight: np.ndarray, threshold: float, beam: int):
    """Links of a shard's members among themselves (rows, equal ones and itself included), and labels of their components."""
    links, labels = weight.astype(np.int64), np.arange(len(weight))
    for a, b in links_of(graph, graph.x, threshold, beam):
        a, b = a[a != b], b[a != b]
        np.add.at(links, a, weight[b])
        labels = merged(labels, a, b)
    return links, labels


def near_duplicates(rows: DataFrame, threshold: float = 0.95, recall: float = 0.99, beam: int = 32) -> DataFrame:
    """vec_id, n_links, component_id, kept for a table of (vec_id, embedding)."""
    spark = ready(rows.sparkSession)
    rows = rows.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    rows = written(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    # Equal vectors are one node.
    nodes = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    nodes = written(nodes.select("node", "weight", "embedding", F.size("embedding").alias("dim")), "nodes")
    sizes = [tuple(r) for r in nodes.groupBy("dim").count().collect()]  # a row per length of vectors
    twins = rows.where("good").select("vec_id", "embedding").join(nodes.select("embedding", "node"), "embedding").select("vec_id", "node")
    found = None
    for dim, count in sizes:
        part = _links(nodes.where(F.col("dim") == dim).select("node", "weight", "embedding"), dim, max(LEAST_SHARDS, -(-count // SHARD_ROWS)), max(1, -(-count // SHARD_ROWS)), threshold, recall, beam)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "found")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select("node", "other").union(twins.where("vec_id != node"))
    joined = components(edges).withColumnRenamed("id", "vec_id")
    out = rows.select("vec_id").join(twins, "vec_id", "left").join(totals, "node", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least member of its set, so far) after joining the sets of a and b pair by pair."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def links_of(graph: Graph, units: np.ndarray, threshold: float, beam: int, block: int = 1_024):
    """Blocks of verified links (query, node)."""
    for lo in range(0, len(units), block):
        a, b = graph.within(units[lo : lo + block], threshold - 1e-9, beam)
        sure = np.einsum("nd,nd->n", units[lo + a], graph.x[b]) >= threshold
        yield a[sure] + lo, b[sure]


def units_of(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    x = flat.reshape(table.num_rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


FOUND = "node long, links long, other long"


def _links(nodes: DataFrame, dim: int, shards: int, blocks: int, threshold: float, recall: float, beam: int) -> DataFrame:
    """node, links (rows that it links with in a shard, equal ones and itself included), other (a node of the shard to connect with).

    A graph is built once per shard, with the links and components of its own members, and written. Then every block of queries meets every
    other shard; a query gets a row for its count, and one for each component of the shard that it links with.
    """
    some = nodes.orderBy(F.xxhash64("node", F.lit(2)), "node").select("node", "embedding")
    drawn = some.limit(max(1, min(AUDITED, AUDITED_NUMBERS // dim))).toArrow()
    sample, sample_units = drawn.column("node").to_numpy(), units_of(drawn)
    target, built_schema = arrow_schema(FOUND), FOUND + ", shard int, graph binary"
    built_target = arrow_schema(built_schema)

    def build(table: pa.Table) -> pa.Table:
        import pickle

        node, weight, x = table.column("node").to_numpy(), table.column("weight").to_numpy(), units_of(table)
        graph = Graph(x)
        width = audited_beam(graph, threshold, recall, beam, node, sample, sample_units)
        links, labels = own_links(graph, weight, threshold, width)
        apart = np.flatnonzero(labels != np.arange(len(node)))
        blob = pickle.dumps((graph, width, node, weight, labels))
        size = len(node) + len(apart) + 1
        columns = {
            "node": pa.array([*node.tolist(), *node[apart].tolist(), None], pa.int64()),
            "links": pa.array([*links.tolist(), *[0] * len(apart), None], pa.int64()),
            "other": pa.array([None] * len(node) + node[labels[apart]].tolist() + [None], pa.int64()),
            "shard": pa.array([None] * (size - 1) + [table.column("shard")[0].as_py()], pa.int32()),
            "graph": pa.array([None] * (size - 1) + [blob], pa.binary()),
        }
        return pa.Table.from_arrays([columns[f.name] for f in built_target], schema=built_target)

    def search(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        import pickle

        if not queries.num_rows or not graphs.num_rows:
            return target.empty_table()
        graph, width, node, weight, labels = pickle.loads(graphs.column("graph")[0].as_py())
        ids, units = queries.column("node").to_numpy(), units_of(queries)
        links, once = np.zeros(len(ids), np.int64), np.empty((2, 0), np.int64)
        for a, b in links_of(graph, units, threshold, width):
            np.add.at(links, a, weight[b])
            if len(a):
                once = np.concatenate([once, np.unique(np.stack([a, labels[b]]), axis=1)], axis=1)
        some = np.flatnonzero(links)
        columns = [*ids[some].tolist(), *ids[once[0]].tolist()], [*links[some].tolist(), *[0] * once.shape[1]], [None] * len(some) + node[once[1]].tolist()
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=target)

    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    members = nodes.withColumn("shard", shard)
    built = written(members.groupBy("shard").applyInArrow(build, built_schema), "graphs")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("own"))
    queries = members.withColumnRenamed("shard", "own").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(others))
    graphs = built.where("shard is not null").select("shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    crossed = queries.select("shard", "block", "node", "embedding").groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInArrow(search, FOUND)
    return built.where("shard is null").select("node", "links", "other").union(crossed)
