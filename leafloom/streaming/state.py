"""What the stateful streams share: the state store, and results that come as updates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.session import fresh_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOLD_EVERY = 16


def use_state_store(spark: SparkSession) -> SparkSession:
    """State with timers and lists needs this store; it keeps state on disk and writes what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Updates:
    """Rows per key that later rows of the key replace, by batch.

    A batch writes a folder named by its number, overwritten when it runs again. Every `FOLD_EVERY` batches the last rows of all keys are written as a base, so that a
    read takes one base and few batches however long the stream has run. ``best`` is compared before the batch, where a later row must not replace one of its kind.
    """

    def __init__(self, spark: SparkSession, out: str, schema: str, key: str, best: Column | None = None):
        self.spark, self.out, self.schema, self.key = spark, out, schema, key
        self.order = F.struct(F.lit(0) if best is None else best, "batch")

    def _part(self, kind: str, below: int | None) -> DataFrame:
        schema = f"{self.schema}, batch long"
        try:
            rows = self.spark.read.schema(schema + ", until long").parquet(f"{self.out}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema + ", until long")
        return rows if below is None else rows.filter(F.col("until") < below)

    def latest(self, below: int | None = None) -> DataFrame:
        """The last row of every key, with its batch: from the newest base and the batches after it."""
        based = self._part("base", below).agg(F.max("until")).first()[0]
        rows = self._part("data", below).filter(F.col("until") > (-1 if based is None else based))
        if based is not None:
            rows = rows.unionByName(self._part("base", below).filter(F.col("until") == based))
        fields = [c for c in rows.columns if c not in (self.key, "until")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*fields), self.order).alias("_l")).select(self.key, "_l.*")

    def save(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.out}/data/until={batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            own = Updates(batch.sparkSession, self.out, self.schema, self.key)
            own.order = self.order
            own.latest(batch_id + 1).write.mode("overwrite").parquet(f"{self.out}/base/until={batch_id}")


def drain(rows: DataFrame, schema: str, key: str, label: str, out: str | None = None, best: Column | None = None) -> DataFrame:
    """Runs a stream of updates to the end of its input and returns the last row of every key. With ``out`` a later call goes on from there."""
    out = out or fresh_path(rows.sparkSession, label)
    updates = Updates(rows.sparkSession, out, schema, key, best)
    query = rows.writeStream.outputMode("update").foreachBatch(updates.save).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return updates.latest().drop("batch")
