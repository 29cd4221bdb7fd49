"""Versioned model state on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import nonzero_count
from ..session import remove_folder


class StateStore:
    """State tables ``state/version=k`` with a row in ``meta/version=k`` written last.

    A version counts as there once its meta row is, which also names the batch it learned
    from and that batch's source. ``keep`` bounds how many state tables stay; meta and
    metrics stay for all versions.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        if keep is not None and keep < 1:
            raise ValueError("at least the last version has to stay")
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/version={version}"

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def latest(self) -> int | None:
        meta = self._read("meta")
        return None if meta is None else meta.agg(F.max("version")).first()[0]

    def learned(self, source: str, batch: str) -> bool:
        """Whether a version has learned from this batch of this source."""
        meta = self._read("meta")
        return meta is not None and not meta.where(
            (F.col("source") == source) & (F.col("batch_name") == batch)
        ).isEmpty()

    def save(
        self, version: int, state: DataFrame, source: str = "", batch: str = "", **settings
    ) -> DataFrame:
        """Write a version and read it back, without the lineage that led to it."""
        path = self._path("state", version)
        state.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(state.schema).parquet(path)
        meta = nonzero_count(written).select(
            "nonzero", F.lit(source).alias("source"), F.lit(batch).alias("batch_name"),
            *[F.lit(v).alias(k) for k, v in settings.items()],
        )
        meta.write.mode("overwrite").parquet(self._path("meta", version))
        if self.keep is not None and version > self.keep:
            remove_folder(self.spark, self._path("state", version - self.keep))
        return written

    def load(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError(f"no model state under {self.root}")
        return self.spark.read.parquet(self._path("state", version))

    def slice_for(self, examples: DataFrame, version: int) -> DataFrame:
        """What of a version's state a batch can touch; here all of it."""
        return self.load(version)

    def save_changes(
        self, version: int, before: DataFrame, after: DataFrame, source: str = "", batch: str = "", **settings
    ) -> DataFrame:
        """The version in which ``after`` stands for ``before``, which ``slice_for`` gave."""
        return self.save(version, after, source, batch, **settings)

    def nonzero(self, version: int) -> int:
        return self.meta().where(F.col("version") == version).first()["nonzero"]

    def meta(self) -> DataFrame:
        return self._read("meta")

    def save_rows(self, table: str, version: int, rows: DataFrame) -> DataFrame:
        """Write what else belongs to a version, before the version itself is saved."""
        path = self._path(table, version)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def rows(self, table: str, version: int | None = None) -> DataFrame | None:
        """Rows saved with all versions that count, with the version number, or those of one version."""
        if version is not None:
            return self.spark.read.parquet(self._path(table, version))
        rows = self._read(table)
        return None if rows is None else rows.where(F.col("version") <= F.lit(self.latest() or 0))

    def save_metrics(self, version: int, metrics: DataFrame) -> None:
        metrics.write.mode("overwrite").parquet(self._path("metrics", version))

    def metrics(self) -> DataFrame:
        """One row (or one per model) for every version, with the version number."""
        return self._read("metrics")
