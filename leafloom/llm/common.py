"""What the operators of this subpackage share: session settings, written stages, input rules.

Inputs. Every operator reads the columns it names and ignores all others, whatever they are called. Operators that
compare documents take one row per `doc_id`: rows without an id are left out, of rows that repeat an id the one with the
least text counts (`one_row_per_id`). Operators that look at each row by itself keep every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.session import fresh_path, prepare


def ready(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, for texts can be long, and shuffle files that go when the job that made them ends:
    every stage is written as a table, so nothing needs them later."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors, and fixes their order within files."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row_per_id(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the columns named, without null ids; of rows that repeat an id the least counts.

    Only the ids are counted first. As long as none repeats, no text is moved.
    """
    docs = docs.select("doc_id", *columns).where(F.col("doc_id").isNotNull())
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return docs
    least = F.min(F.struct(*columns)).alias("row")
    merged = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least)
    return docs.join(repeated, "doc_id", "left_anti").unionByName(merged.select("doc_id", *[F.col("row")[c].alias(c) for c in columns]))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def in_batches(df: DataFrame, schema: str | T.StructType, step: Callable[[pa.RecordBatch], dict | None], start: Callable | None = None) -> DataFrame:
    """mapInArrow with a function from a batch to columns (lists or arrays by name)."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def shard_count(spark: SparkSession, rows: int, each: int, least: int = 48) -> int:
    """Shards so that each gets about `each` rows; grows with the data, so memory per shard does not."""
    return max(least, -(-rows // each))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(dict):
    """64-bit hashes of words, remembered up to a bound; beyond it they are computed each time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


_words = Words()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`; bytes.split() cuts at exactly these six characters."""
    words = text.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` words (log steps of doubling); empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, have, size, done = None, 0, 1, width
    power = h  # hashes of runs of `size` words
    while True:
        if done & size:
            part = power[have : have + n]
            acc = part if acc is None else mix(acc * np.uint64(0x9E3779B97F4A7C15) + part)
            have += size
        size *= 2
        if size > done:
            break
        half = size // 2
        power = mix(power[:-half] * np.uint64(0x9E3779B97F4A7C15) + power[half:]) if len(power) > half else power[:0]
    return mix(acc + np.uint64(width))
