"""Toxicity scores by weak supervision.

1. Voters: words of a small lexicon, patterns, and terms (words, and stems that many words of a text begin with) that mark toxic rows in a bounded sample of
   labelled rows. A voter fires on a document or abstains; "nothing fired" is a voter too.
2. Label model: the sets of voters that fire are counted over all documents. A generative model with a hidden class is fitted to them:
   rates of each voter within both classes (its accuracy), and the correlation of pairs that the class leaves unexplained, by which voters that
   repeat each other share their weight.
3. A linear classifier with an L1 penalty is trained on the posteriors of the sampled rows, over all their frequent terms.
4. Every whole text is scored.

Labels, language, source and id are never features. Rows are scored one by one, so null ids and repeated rows are no matter; null and empty texts get the
score of a text without any known term. Without labelled rows, the lexicon alone votes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.llm.common import arrow_schema, in_batches, ready, written

#: Insults that vote whatever the labels say.
LEXICON = """
idiot moron stupid trash clown loser pathetic worthless disgusting scum imbecile dumb
idiota estupido estúpido basura payaso imbécil asqueroso
idiote stupide crétin ordure abruti minable
dummkopf trottel abschaum widerlich erbärmlich
""".split()
#: Patterns that vote.
PATTERNS = {"shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){6}"), "marks": re.compile(r"[!?]{3}"), "masked": re.compile(r"\b[a-z]+[*@$]+[a-z]+\b"), "address": re.compile(r"\byou (?:are|re) (?:a|an|so)\b")}

SAMPLE = 16_000  # labelled rows that voters and classifier are fitted on, those with the least hash of their id
TERMS = 20_000
VOTERS = 200
ROUNDS = 4
SUPPORT = 0.015  # of the toxic rows
WORD = re.compile(r"\w+")
THRESHOLD = 0.3


def held_out() -> Column:
    """Rows of this fold are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


LENGTHS = range(3, 9)


def counted_words(text: str | None) -> tuple[Counter, int]:
    words = WORD.findall((text or "").lower())
    return Counter(words), len(words)


def dense(stems: Counter, total: int) -> set[str]:
    """Stems that one word in a hundred begins with: marked * if two words at least do, ** if three do."""
    often = [(s, n) for s, n in stems.items() if n > 1 and 100 * n >= total]
    return {s + "*" for s, _ in often} | {s + "**" for s, n in often if n > 2}


def terms_of(text: str | None) -> set[str]:
    """Words of a text, and the stems (beginnings of 3 to 8 letters of longer words) that are dense in it."""
    words, total = counted_words(text)
    stems: Counter = Counter()
    for word, n in words.items():
        for k in LENGTHS:
            if len(word) > k:
                stems[word[:k]] += n
    return {w for w in words if 2 < len(w) < 40} | dense(stems, total)


class Terms:
    """A set of known terms; finds them in a text without forming any others."""

    def __init__(self, terms):
        self.words = {t for t in terms if t[-1] != "*"}
        self.stems = {t.rstrip("*") for t in terms if t[-1] == "*"}
        self.marked = {t for t in terms if t[-1] == "*"}
        self.gates = {s[: LENGTHS[0]] for s in self.stems}

    def __call__(self, text: str | None) -> set[str]:
        words, total = counted_words(text)
        stems: Counter = Counter()
        for word, n in words.items():
            if word[:3] in self.gates:
                for k in LENGTHS:
                    if len(word) > k and word[:k] in self.stems:
                        stems[word[:k]] += n
        return (self.words & words.keys()) | (dense(stems, total) & self.marked)


class Voters:
    """Numbers of the voters that fire on a text."""

    def __init__(self, terms: list[str], patterns: list[str]):
        words = list(dict.fromkeys([*LEXICON, *terms]))
        self.names = words + patterns
        self.numbers = {t: i for i, t in enumerate(words)}
        self.patterns = [(len(words) + i, PATTERNS[n]) for i, n in enumerate(patterns)]
        self.terms = Terms(self.numbers)

    def fired(self, text: str | None) -> list[int]:
        return sorted([self.numbers[t] for t in self.terms(text)] + [i for i, p in self.patterns if p.search(text or "")])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic (0 or 1, the majority of an id's labels) of at most SAMPLE rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # Copies count once.
    return written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")


def frequent_terms(sample: DataFrame) -> list[tuple[str, int, int]]:
    """Terms, toxic and other rows that have them: the TERMS most telling ones of those with enough support, with odds 4.5 times the usual or
    less than a 4.5th."""
    ratio = sample.agg((F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)) + 1) / (F.coalesce(F.sum("toxic"), F.lit(0)) + 1)).first()[0]

    def run(batches):
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else other).update(terms_of(text))
            names = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([other[t] for t in names], pa.int64())], names=["term", "toxic", "other"])

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5) * ratio)
    support = F.lit(max(5.0, SUPPORT * sample.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]))
    rows = counted.where(F.col("toxic") + F.col("other") >= support).where(F.abs(odds) > 1.5).orderBy(F.desc(F.abs(odds) * F.sqrt(F.col("toxic") + F.col("other") / ratio)), "term").limit(TERMS).collect()
    return [tuple(r) for r in rows]


def telling_patterns(sample: DataFrame) -> list[str]:
    """Patterns that at least twice as large a share of toxic rows has as of others; all of them if no row has a label."""

    def found(batch):
        return {"toxic": batch.column("toxic"), "names": [[n for n, p in PATTERNS.items() if p.search(t or "")] for t in batch.column("text").to_pylist()]}

    rows = in_batches(sample.select("text", "toxic"), "toxic int, names array<string>", found)
    counts = {(r[0], r[1]): r[2] for r in rows.select("toxic", F.explode(F.concat("names", F.array(F.lit("")))).alias("name")).groupBy("toxic", "name").count().collect()}
    share = lambda n, toxic: (counts.get((toxic, n), 0) + 0.5) / (counts.get((toxic, ""), 0) + 1)
    return [n for n in PATTERNS if not counts or share(n, 1) >= 2 * share(n, 0)]


def fired_sets(docs: DataFrame, voters) -> DataFrame:
    """The distinct sets of voters that fire on documents of the whole table, with the number of documents."""

    def run(batches):
        for batch in batches:
            sets = Counter(tuple(voters.value.fired(text)) for text in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in sets], pa.list_(pa.int32())), pa.array(list(sets.values()), pa.int64())], names=["fired", "n"])

    counted = docs.select("text").mapInArrow(run, "fired array<int>, n long").groupBy("fired").agg(F.sum("n").alias("n"))
    return written(counted, "fired")


class LabelModel:
    """Rates at which voters fire in both classes, and the correlation of voters within the toxic one.

    A document's class is hidden. Rates are found by expectation maximisation over all documents, from the given start and prior. Voters whose
    joint rate is above what the class explains repeat each other and share their weight: ones that always fire together weigh as one. The last number
    stands for "no voter fires".
    """

    def __init__(self, size: int, prior: float, start: np.ndarray):
        self.size, self.prior, self.total = size, prior, 1.0
        self.a = np.clip(start, 1e-4, 0.95)
        self.b = np.full(size, 1e-3)
        self.b[-1] = 0.95
        self.shared = np.ones(size)

    @property
    def weights(self) -> np.ndarray:
        return np.log(self.a / self.b) / self.shared

    def posterior(self, fired: list[int]) -> float:
        odds = np.log(self.prior / (1 - self.prior)) + self.weights[fired or [self.size - 1]].sum()
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

    def improve(self, sets: DataFrame) -> None:
        """One round: expected counts of single voters and of pairs (voters squared rows at most), then new rates."""
        schema, model, size = arrow_schema("i int, j int, n double, q double"), self, self.size

        def run(batches):
            n_of, q_of = Counter(), Counter()
            for batch in batches:
                for fired, n in zip(batch.column("fired").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    own, q = fired or [size - 1], n * model.posterior(fired)
                    for key in [(-1, -1), *((i, j) for k, i in enumerate(own) for j in own[k:])]:
                        n_of[key] += n
                        q_of[key] += q
            keys = list(n_of)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([float(n_of[k]) for k in keys]), pa.array([q_of[k] for k in keys])], schema=schema)

        n, q, total, mass = np.zeros((size, size)), np.zeros((size, size)), 0.0, 0.0
        for i, j, all_, toxic in sets.mapInArrow(run, "i int, j int, n double, q double").groupBy("i", "j").agg(F.sum("n"), F.sum("q")).collect():
            if i < 0:
                total, mass = all_, toxic
            else:
                n[i, j], n[j, i], q[i, j], q[j, i] = all_, all_, toxic, toxic
        if not total:
            return
        self.a = np.clip((np.diag(q) + 0.1) / (mass + 1), 1e-5, 0.95)
        self.b = np.clip((np.diag(n) - np.diag(q) + 0.05) / (total - mass + 1), 1e-7, 0.999)
        self.prior = float(np.clip(mass / total, 1e-3, 0.5))
        spread = np.sqrt(np.outer(self.a * (1 - self.a), self.a * (1 - self.a)))
        correlation = (q / max(mass, 1.0) - np.outer(self.a, self.a)) / spread
        np.fill_diagonal(correlation, 0)
        self.shared = 1 + (np.clip(correlation, 0, 1) ** 2).sum(axis=1)


def train_linear(rows: list[np.ndarray], targets: np.ndarray, size: int, penalty: float = 1e-4, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression on sets of terms with an L1 penalty (accelerated proximal gradient)."""
    cols = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, bias = max(len(rows), 1), float(np.log((targets.mean() + 1e-6) / (1 - targets.mean() + 1e-6)))
    # The step is bounded by the largest eigenvalue of the Gram matrix, found by power iteration.
    v = np.ones(size)
    for _ in range(20):
        v = np.bincount(cols, np.bincount(owner, v[cols], n)[owner], size)
        norm = np.linalg.norm(v)
        v = v / norm if norm else v
    step = 4 * n / max(norm + n, 1.0)
    w = z = np.zeros(size)
    b, zb, t = bias, bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(zb + np.bincount(owner, z[cols], n), -30, 30)))
        error = p - targets
        moved = z - step * np.bincount(cols, error[owner], size) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = zb - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return b, w


class Model:
    """Bias and weights of the terms that have one."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.terms = bias, weights, Terms(weights)

    def score(self, text: str | None) -> float:
        odds = self.bias + sum(self.weights[t] for t in sorted(self.terms(text)))
        return float(1 / (1 + np.exp(-min(max(odds, -30), 30))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = labelled_sample(docs, labels)
    terms = frequent_terms(sample)
    good = sorted((t for t in terms if t[1] >= 4 and t[1] >= 0.8 * (t[1] + t[2])), key=lambda t: (-t[1], t[0]))
    voters = Voters([t[0] for t in good[:VOTERS]], telling_patterns(sample))
    shared = spark.sparkContext.broadcast(voters)
    index = {t[0]: i for i, t in enumerate(terms)}
    shared_index = spark.sparkContext.broadcast(index)

    def features(batch):
        texts = batch.column("text").to_pylist()
        found = [[shared_index.value[t] for t in terms_of(x) if t in shared_index.value] for x in texts]
        return {"toxic": batch.column("toxic"), "terms": [sorted(f) for f in found], "fired": [shared.value.fired(x) for x in texts]}

    # At most SAMPLE rows of term numbers.
    rows = in_batches(sample.select("text", "toxic"), "toxic int, terms array<int>, fired array<int>", features).collect()
    sets = fired_sets(docs, shared)
    toxic = np.array([r.toxic for r in rows], float)
    size = len(voters.names) + 1
    hits = np.zeros(size)
    for r in rows:
        if r.toxic:
            np.add.at(hits, r.fired or [size - 1], 1)
    prior = float(np.clip((toxic.sum() + 1) / (len(rows) + 20), 1e-3, 0.5))
    start = (hits + 0.5) / (toxic.sum() + 1) if toxic.sum() else np.append(np.full(size - 1, 0.2), 0.1)
    label_model = LabelModel(size, prior, start)
    for _ in range(ROUNDS):
        label_model.improve(sets)
    posteriors = np.array([label_model.posterior(list(r.fired)) for r in rows])
    if not len(rows):
        known = {n: float(w) for n, w in zip(voters.names, label_model.weights, strict=False) if n in voters.numbers}
        return Model(float(np.log(prior / (1 - prior)) + min(label_model.weights[-1], 0)), known)
    bias, weights = train_linear([np.array(r.terms, np.int64) for r in rows], posteriors, len(terms))
    return Model(bias, {t[0]: float(w) for t, w in zip(terms, weights, strict=True) if w})


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; fits on `labels` (doc_id, toxic) outside the held-out fold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def step(batch):
        found = [model.value.score(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": found, "predicted": [int(s >= THRESHOLD) for s in found]}

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return in_batches(rows, "doc_id long, held_out boolean, score double, predicted int", step)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = [model.value.score(t) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
