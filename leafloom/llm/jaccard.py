"""Similarity join of documents by the Jaccard index of their word shingles, through a token-group matrix.

1. Shingles that many documents share are counted over the whole table; the most frequent (a bounded list, broadcast) come last
   in the order of shingles, all others are ordered by hash. The order decides cost, never the result.
2. By the prefix principle two documents link only if they share one of the first `n - ceil(0.8 n) + 1` of their n shingles. Prefixes are
   dealt out by shingle in packed shards; what only one document holds drops out there.
3. Similar documents are partitioned into groups: each document is compared with two chosen documents of each shingle it shares.
4. Token-group matrix: per shingle the groups whose union of prefixes holds it. Shared entries bound the overlap of any two members of two
   groups; only pairs of groups whose bound suffices are opened, their members paired, bounded again and verified on whole sets.
5. Components over verified links.

Equal sets within a task are one document, and a frequent shingle is salted over shards, so groups of copies and frequent
passages are split. Every link between different texts either is found or joins documents that are connected already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import arrow_schema, in_batches, mix, one_row_per_id, ready, shard_count, window_hashes, word_hashes, written
from leafloom.llm.components import components

HOT_TOKENS = 200_000  # 16 bytes each: the bound of what is broadcast
HOT_FROM = 10
SALT_ROWS = 20_000  # rows of one shingle in one shard, about
ROUNDS, CANDIDATES = 6, 4  # of comparisons with chosen documents, and documents that one is compared with in a round
DEALS, HAND = 2, 8  # so often the documents of a shingle are dealt in a round, and about so many together
FEW_OF = 500  # a round that links fewer than one in so many documents is the last


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words make one shingle, none make none."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(words, len(h))))


def frequent_tokens(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, from all documents: each task reports those it met more than once."""

    def run(batches):
        held, size = [], 0

        def report():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(shingles(text, words))
                size += len(held[-1])
                if size > 4_000_000:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    rows = counted.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toPandas()
    return rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


class Order:
    """The order of shingles: by hash, the frequent ones last, the most frequent at the very end."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]
        self.rank = np.empty(len(by), np.uint64)
        self.rank[np.lexsort((self.tokens, self.counts))] = np.arange(len(by), dtype=np.uint64)

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order (62 bits and a bit), and the count of frequent ones (0: not frequent)."""
        place, count = tokens >> np.uint64(2), np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            hot = self.tokens[at] == tokens
            place[hot] = np.uint64(1 << 62) + self.rank[at[hot]]
            count[hot] = self.counts[at[hot]]
        return place, count


def prefixes(docs: DataFrame, order, shards: int, words: int, percent: int) -> DataFrame:
    """Two kinds of rows. Of every document: doc_id, n_shingles, the least document of its task with the same set (twin), a key of the
    set, and the place in the order where its prefix ends. Of every shard: prefix entries (shingles, documents) of the twins, packed."""
    schema = "doc_id long, n_shingles long, twin long, key binary, end long, shard long, entries binary"
    target = arrow_schema(schema)

    def run(batches):
        import xxhash
        import zstandard
        names, squeeze = [f.name for f in target], zstandard.ZstdCompressor(level=1).compress

        def made(columns: dict):
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * size), type=target.field(n).type) for n in names], schema=target)

        first: dict[bytes, int] = {}
        held: list = []

        def flush():
            tokens, owners, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(shard, kind="stable")
            tokens, owners, shard = tokens[by], owners[by], shard[by]
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            packed = [squeeze(tokens[i:j].tobytes() + np.diff(owners[i:j], prepend=0).tobytes()) for i, j in zip(cuts, np.append(cuts[1:], len(shard)), strict=True)]
            held.clear()
            return made({"shard": shard[cuts].astype(np.int64), "entries": packed})

        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "n_shingles", "twin", "key", "end")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = shingles(text, words)
                n = len(tokens)
                key = xxhash.xxh3_128_digest(tokens.tobytes()) if n else None
                twin, end = first.setdefault(key, doc) if n else doc, None
                if twin == doc and n:
                    place, count = order.value.keys(tokens)
                    by = np.argsort(place, kind="stable")[: n - -(-percent * n // 100) + 1]
                    end = int(place[by[-1]])
                    salt = mix(np.array([doc], np.int64).view(np.uint64)) % np.maximum(1, -(-count[by] // SALT_ROWS)).astype(np.uint64)
                    held.append((tokens[by], np.full(len(by), doc, np.int64), (mix(tokens[by]) + salt) % np.uint64(shards)))
                for k, v in (("doc_id", doc), ("n_shingles", n), ("twin", twin), ("key", key), ("end", end)):
                    out[k].append(v)
            yield made(out)
            if sum(len(h[0]) for h in held) > 1_500_000:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, schema)


def shared_entries(packed: DataFrame, order) -> DataFrame:
    """Prefix entries whose shingle another document of the shard holds as well, or that are salted."""

    def step(table: pa.Table) -> pa.Table:
        import zstandard

        raw = [zstandard.decompress(x.as_py()) for x in table.column("entries")]
        tokens = np.concatenate([np.frombuffer(x[: len(x) // 2], np.uint64) for x in raw])
        owners = np.concatenate([np.cumsum(np.frombuffer(x[len(x) // 2 :], np.int64)) for x in raw])
        by = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[by], owners[by]
        cuts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        n = np.diff(np.append(cuts, len(tokens)))
        keep = np.repeat((n > 1) | (order.value.keys(tokens[cuts])[1] > SALT_ROWS), n)
        return pa.Table.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(owners[keep])], names=["token", "doc"])

    return packed.groupBy("shard").applyInArrow(step, "token long, doc long")


def in_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """token, doc, group: the entries of the shingles that lie in several groups. A document without a group is one of its own."""
    member = entries.join(groups.select(F.col("id").alias("doc"), F.col("component").alias("group")), "doc", "left").select("token", "doc", F.coalesce("group", "doc").alias("group"))
    member = written(member, "member")
    mixed = member.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("token")
    return written(member.join(mixed, "token", "left_semi"), "member")


def joined(entries: DataFrame, twins: DataFrame, info: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing documents with chosen ones of the shingles they hold, and the groups that links and twins make.

    A round names two documents of each shingle: the one whose shingles are the most frequent, so that copies of a text meet the text
    itself, and the least, later one that differs from round to round. Each document is compared with the CANDIDATES of other groups that most of its
    shingles name, and with none twice. Rounds end when one joins few, or after ROUNDS: what they miss is left to the matrix.
    """
    counts = entries.groupBy("token").agg(F.count("*").alias("n"))
    lists = entries.join(counts, "token").groupBy("doc").agg(F.avg("n").alias("usual"), F.collect_list("token").alias("tokens"))
    lists = written(lists, "lists")
    links, groups, tried = twins, written(components(twins), "groups"), None
    for turn in range(ROUNDS):
        if turn == 0:
            member = entries.withColumn("group", F.col("doc")).join(lists.select("doc", "usual"), "doc")
            chosen = [F.max_by(F.struct("doc", "group"), F.struct("usual", "doc")), F.min(F.struct("doc", "group"))]
            on = ["token"]
        else:
            # A few documents of a shingle each, dealt anew each round.
            member = in_groups(entries, groups).join(counts, "token")
            deals = [F.struct(F.lit(k).alias("deal"), F.pmod(F.xxhash64("doc", F.lit(DEALS * turn + k)), F.ceil(F.col("n") / HAND)).alias("hand")) for k in range(DEALS)]
            member = member.select("token", "doc", "group", F.explode(F.array(*deals)).alias("at"))
            chosen, on = [F.min_by(F.struct("doc", "group"), F.xxhash64("doc", F.lit(turn)))], ["token", "at"]
        centers = member.groupBy(on).agg(F.array_distinct(F.array(*chosen)).alias("to"))
        met = member.join(centers, on).select("doc", "group", F.explode("to").alias("to"))
        met = met.where("group != to.group").groupBy("doc", F.col("to.doc").alias("to")).agg(F.count("*").alias("named"))
        if tried is not None:
            met = met.join(tried.select(F.col("a").alias("doc"), F.col("b").alias("to")).union(tried.select("b", "a")), ["doc", "to"], "left_anti")
        most = F.slice(F.sort_array(F.collect_list(F.struct("named", "to")), False), 1, CANDIDATES)
        pairs = met.groupBy("doc").agg(most.alias("most")).select("doc", F.explode("most.to").alias("to"))
        pairs = written(pairs.select(F.greatest("doc", "to").alias("a"), F.least("doc", "to").alias("b")).distinct(), "named")
        tried = pairs if tried is None else tried.union(pairs)
        for side in "ab":
            pairs = pairs.join(lists.select(F.col("doc").alias(side), F.col("tokens").alias(f"{side}_tokens")), side)
        pairs = possible(pairs.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("shared")), info, percent)
        found = verified(written(pairs, "pairs"), docs, words, percent)
        links = links.union(found)
        groups = written(components(links), "groups")
        if found.count() * FEW_OF < lists.count():
            break
    return links, groups


def with_info(pairs: DataFrame, info: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(info.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"{side}_size"), F.col("end").alias(f"{side}_end")), side)
    return pairs


def share(size, percent: int):
    """The least overlap that a set of a size needs with any other."""
    return F.ceil(size * percent / F.lit(100))


def overlap(a, b, percent: int):
    """The overlap that sets of two sizes need."""
    return F.ceil((a + b) * percent / F.lit(100 + percent))


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, number of shared prefix entries) that can still reach the overlap they need.

    All shared shingles up to the earlier of the two prefix ends were seen; the document with that end has only those behind its prefix left.
    """
    a, b = F.col("a_size"), F.col("b_size")
    bound = F.col("shared") + F.when(F.col("a_end") <= F.col("b_end"), share(a, percent)).otherwise(share(b, percent)) - 1
    fits = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return with_info(pairs, info).where(fits & (bound >= overlap(a, b, percent))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(ids, "doc_id", "left_semi")

    def to_sets(batch):
        return {"doc_id": batch.column("doc_id"), "tokens": [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]}

    sets = written(in_batches(texts, "doc_id long, tokens binary", to_sets), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("b_tokens")), "b")

    def compare(batch):
        out: dict = {"a": [], "b": []}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_tokens", "b_tokens")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return written(in_batches(both, "a long, b long", compare), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least document reachable by links) of every document.

    Takes one row per id (`one_row_per_id`). Null texts and texts without words have no shingles and link with nothing. An
    empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    docs = one_row_per_id(docs, "text")
    order = spark.sparkContext.broadcast(Order(*frequent_tokens(docs, words)))
    # A document has some hundred shingles; a fifth of them are prefix entries, 32 bytes each.
    shards = shard_count(spark, docs.count(), 4_000)
    packed = written(prefixes(docs, order, shards, words, percent), "prefixes")
    rows = packed.where("shard is null").select("doc_id", "n_shingles", "twin", "key", "end")
    info = rows.where("end is not null")
    entries = written(shared_entries(packed.where("shard is not null").select("shard", "entries"), order), "entries")

    # Equal sets are one document from here on: the least of all with that set stands for the least ones of the tasks.
    equal = info.groupBy("key").agg(F.min("doc_id").alias("least"))
    copies = written(info.join(equal, "key").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).where("a != b"), "copies")
    twins = copies.union(rows.select(F.col("doc_id").alias("a"), F.col("twin").alias("b")).where("a != b"))
    entries = entries.join(copies.withColumnRenamed("a", "doc"), "doc", "left").select("token", F.coalesce("b", "doc").alias("doc")).distinct()
    first, groups = joined(written(entries, "entries"), twins, info, docs, words, percent)

    # Token-group matrix, of the shingles that lie in several groups.
    member = in_groups(entries, groups)
    sizes = member.select("doc", "group").distinct().join(info.select(F.col("doc_id").alias("doc"), "n_shingles"), "doc")
    sizes = sizes.groupBy("group").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    matrix = written(member.select("token", "group").distinct().join(sizes, "group"), "matrix")
    g, h = matrix.alias("g"), matrix.alias("h")
    fits = (F.col("g.group") < F.col("h.group")) & (100 * F.col("g.most") >= percent * F.col("h.least")) & (100 * F.col("h.most") >= percent * F.col("g.least"))
    met = g.join(h, (F.col("g.token") == F.col("h.token")) & fits)
    met = met.select(F.col("g.token").alias("token"), F.col("g.group").alias("g"), F.col("h.group").alias("h"), F.col("g.least").alias("g_least"), F.col("h.least").alias("h_least"), F.greatest("g.most", "h.most").alias("most"))
    met = written(met, "met")
    enough = overlap(F.col("g_least"), F.col("h_least"), percent) - share(F.col("most"), percent) + 1
    qualifying = met.groupBy("g", "h", "g_least", "h_least", "most").agg(F.count("*").alias("shared")).where(F.col("shared") >= enough).select("g", "h")
    # Opened at the shingles that both share.
    opened = written(met.select("token", "g", "h").join(qualifying, ["g", "h"], "left_semi"), "opened")
    # Members of a group with the same entries are one class: shared entries are counted by class, and classes that can reach the overlap are
    # spelled out as documents.
    marks = [F.sum(F.xxhash64("token", F.lit(k)).cast("decimal(38,0)")).alias(f"mark_{k}") for k in (1, 2)]
    alike = written(member.groupBy("doc", "group").agg(F.count("*").alias("entries"), *marks), "alike")
    same = ["group", "entries", "mark_1", "mark_2"]
    classes = alike.groupBy(*same).agg(F.min("doc").alias("class"))
    classes = alike.join(classes, same).select("doc", "class").join(info.select(F.col("doc_id").alias("doc"), "n_shingles"), "doc")
    classes = written(classes, "classes")
    spans = classes.groupBy("class").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    chosen = written(member.join(spans, member["doc"] == spans["class"]).select("token", "group", "class", "least", "most"), "chosen")
    side = lambda group, n: chosen.select("token", F.col("group").alias(group), F.col("class").alias(f"{n}_class"), F.col("least").alias(f"{n}_least"), F.col("most").alias(f"{n}_most"))
    near = (100 * F.col("x_most") >= percent * F.col("y_least")) & (100 * F.col("y_most") >= percent * F.col("x_least"))
    x = opened.join(side("g", "x"), ["token", "g"]).alias("x")
    y = side("h", "y").alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.h") == F.col("y.h")) & near)
    keys = ["x_class", "y_class", "x_least", "y_least", "x_most", "y_most"]
    met = met.groupBy(*keys).agg(F.count("*").alias("shared"))
    enough = overlap(F.col("x_least"), F.col("y_least"), percent) - share(F.greatest("x_most", "y_most"), percent) + 1
    met = written(met.where(F.col("shared") >= enough).select("x_class", "y_class", "shared"), "classes")
    spelled = met.join(classes.select(F.col("class").alias("x_class"), F.col("doc").alias("x")), "x_class").join(classes.select(F.col("class").alias("y_class"), F.col("doc").alias("y")), "y_class")
    met = spelled.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "shared")
    rest = verified(written(possible(met, info, percent), "pairs"), docs, words, percent)

    final = components(first.union(rest)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
