"""Versioned subject trees, copied on write per subject.

``data/version=<n>/subject_key=<s>`` holds the rows of a subject as version ``n`` wrote them; ``manifest/version=<n>`` has one row per subject with the
data version that is current in version ``n``. A version writes only the subjects it touches and is committed by its manifest, one small
file, after its data: readers see all of it or nothing. A version that is written again replaces itself. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.session import broadcast_when_small

SOURCE = "struct<source_id:int,publisher:string,book_slug:string,pages:array<int>,paragraph_ids:array<int>,authority_rank:int,ingested_at:string>"
COLUMNS = {
    "subject": "string",
    "node_id": "string",
    "parent": "string",
    "depth": "int",
    "order": "int",
    "name": "string",
    "body": "string",
    "sources": f"array<{SOURCE}>",
    "content_hash": "string",
}
SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in COLUMNS.items())


def subject_key(subject: Column) -> Column:
    """A folder name for every subject, null and empty ones too."""
    return F.coalesce(F.concat(F.lit("s-"), subject), F.lit("none"))


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> DataFrame:
        """``(version, subject_key, data_version)`` of all committed versions."""
        schema = "subject_key string, data_version long, version long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def latest(self, until: int | None = None) -> int | None:
        """The last committed version, or the last one up to ``until``; None if there is none."""
        rows = self._manifests()
        return (rows if until is None else rows.filter(F.col("version") <= until)).agg(F.max("version")).first()[0]

    def manifest(self, version: int | None) -> DataFrame:
        """``(subject_key, data_version)`` of one version: a row per subject."""
        return self._manifests().filter(F.lit(False) if version is None else F.col("version") == version).drop("version")

    def read(self, version: int | None = None, subjects: DataFrame | None = None) -> DataFrame:
        """The trees of a version (None: the last one), of all subjects or of those with a ``subject_key`` in ``subjects``.

        Folders of versions that nothing is current in are not listed; of the others the join prunes the subjects' folders.
        """
        current = self.manifest(self.latest() if version is None else version)
        if subjects is not None:
            current = current.join(subjects.select("subject_key").distinct(), "subject_key", "left_semi")
        # A number per version that is still current for a subject.
        versions = sorted(r[0] for r in current.select("data_version").distinct().collect())
        if not versions:
            return self.spark.createDataFrame([], SCHEMA)
        data = f"{self.root}/data"
        rows = self.spark.read.schema(SCHEMA + ", version long, subject_key string").option("basePath", data).parquet(*[f"{data}/version={v}" for v in versions])
        current = broadcast_when_small(current.withColumnRenamed("data_version", "version"))
        return rows.join(current, ["version", "subject_key"], "left_semi").select(*COLUMNS)

    def commit(self, rows: DataFrame, version: int, base: int | None, check: Callable[[], None] | None = None) -> None:
        """Writes ``rows``, whole trees of the subjects that change, as ``version``; all other subjects stay as they are in ``base``.

        ``check`` is called between the data and the manifest: what it raises leaves the version uncommitted.
        """
        path = f"{self.root}/data/version={version}"
        keyed = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()], subject_key(F.col("subject")).alias("subject_key"))
        # Rebalancing splits a large subject over tasks and keeps a small one in one file.
        keyed.hint("rebalance", "subject_key").write.mode("overwrite").option("compression", "zstd").partitionBy("subject_key").parquet(path)
        if check:
            check()
        try:
            touched = self.spark.read.schema(SCHEMA + ", subject_key string").parquet(path).select("subject_key").distinct()
        except AnalysisException as missing:  # no rows, no files
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            touched = self.spark.createDataFrame([], "subject_key string")
        kept = self.manifest(base).join(touched, "subject_key", "left_anti")
        after = kept.unionByName(touched.withColumn("data_version", F.lit(version).cast("long")))
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
