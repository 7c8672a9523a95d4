"""Session, table and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "leafloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks. On a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, for any session handed in.

    Spark 4.1 lets a union keep the partitioning of its inputs. With inputs that adaptive execution
    coalesces differently, a later aggregation without a shuffle then returns a key more than once.
    Shuffle files go when the job that made them ends: what later jobs read is a table or a checkpoint.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


class Tables:
    """Lazy parquet tables of one directory; a table is read only when asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = prepare(spark)
        self.directory = directory.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return self._spread(df) if name == "documents" else df

    def _spread(self, df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
        """Text work is heavy, and a row group is one task at most, however many splits a scan makes of its file. A small scan, of up to four splits
        per core, whose rows lie in fewer splits than there are cores is dealt out. Any larger table is read as it is, without a shuffle and
        without the count. For a stream, ``scan`` is the table it reads."""
        scan, cores = scan or df, self.spark.sparkContext.defaultParallelism
        if scan.rdd.getNumPartitions() > 4 * cores:
            return df
        filled = scan.select(F.spark_partition_id().alias("_p")).distinct().count()  # reads footers only
        return df.repartition(cores) if filled < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that survives executor loss: what the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage like a checkpoint, and later reads take only the columns they need."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_when_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint only after counting the rows; otherwise the frame is left to a shuffle join."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
