"""Model state whose update costs what the batch touched: a base, and one delta per version, in buckets by feature."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.features import exploded
from ..operators.state import STATE_COLUMNS, empty_state
from ..session import remove_folder
from .store import StateStore

BUCKETS = 64
COMPACT_EVERY = 8
# Rewrite the base earlier where the deltas hold so many rows of the base's.
COMPACT_SHARE = 0.5


class DeltaStore(StateStore):
    """Versions as ``base/version=k`` now and then, and ``delta/version=k`` with the features that version changed.

    All of these tables are bucketed and sorted by feature, by the number of buckets the store began with, so that they
    join with each other and with anything dealt to the same buckets without being moved. A
    feature's row is that of the newest delta that has it, else the base's. ``rows_of`` brings in the rows of some
    features, ``save_changes`` writes theirs alone. A new base is written every ``compact_every`` versions, or once the deltas
    hold ``compact_share`` of the base's rows. ``keep`` versions can be loaded; older deltas and bases go.
    """

    def __init__(
        self, spark: SparkSession, root: str, keep: int | None = None, buckets: int = BUCKETS,
        compact_every: int = COMPACT_EVERY, compact_share: float = COMPACT_SHARE,
    ):
        super().__init__(spark, root, keep)
        meta = self.meta()
        if meta is not None:
            buckets = meta.agg(F.max(F.struct("version", "buckets"))["buckets"]).first()[0]
        self.buckets, self.compact_every, self.compact_share = buckets, compact_every, compact_share
        # A bucket is one sorted file here, so Spark need not sort it again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    # --- tables ---

    def _name(self, kind: str, version: int) -> str:
        """The catalogue's name of a table; the same in every session."""
        return f"state_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{kind}_{version}"

    def _write(self, kind: str, version: int, rows: DataFrame) -> DataFrame:
        """A task per bucket, which writes one sorted file."""
        name = self._name(kind, version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows.select("feature", *STATE_COLUMNS).repartition(self.buckets, "feature").write.mode("overwrite").option(
            "path", self._path(kind, version)).bucketBy(self.buckets, "feature").sortBy("feature").saveAsTable(name)
        return self.spark.table(name)

    def _table(self, kind: str, version: int) -> DataFrame:
        """A table that this or an earlier session has written."""
        name = self._name(kind, version)
        if not self.spark.catalog.tableExists(name):
            schema: StructType = empty_state(self.spark).schema
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet OPTIONS (path '{self._path(kind, version)}') "
                f"CLUSTERED BY (feature) SORTED BY (feature) INTO {self.buckets} BUCKETS")
        return self.spark.table(name)

    def _parts(self, version: int) -> tuple[int, list[int]]:
        """The base of a version, and the deltas since then."""
        base = self._read("bases").where(F.col("version") <= version).agg(F.max("version")).first()[0]
        return base, list(range(base + 1, version + 1))

    def _write_base(self, version: int, state: DataFrame) -> DataFrame:
        written = self._write("base", version, state)
        self.spark.range(1).write.mode("overwrite").parquet(self._path("bases", version))
        return written

    # --- reading ---

    def load(self, version: int | None = None) -> DataFrame:
        """All features of a version, merged on read."""
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError(f"no model state under {self.root}")
        base, deltas = self._parts(version)
        parts = [self._table("base", base), *[self._table("delta", k) for k in deltas]]
        whole = parts[-1]
        # What a newer part has is left out of the older ones. No part is moved, as all lie in the same buckets.
        for k, part in enumerate(parts[:-1]):
            for newer in parts[k + 1:]:
                part = part.join(newer.select("feature"), "feature", "left_anti")
            whole = whole.unionByName(part)
        return whole.select("feature", *STATE_COLUMNS)

    def rows_of(self, features: DataFrame, version: int | None = None) -> DataFrame:
        """The state of some (distinct) features, those it has. Only the features are moved, none of the state."""
        version = self.latest() if version is None else version
        if version is None:
            return empty_state(self.spark)
        base, deltas = self._parts(version)
        found = features.select("feature")
        row = F.lit(None)
        for kind, k in [("base", base), *[("delta", d) for d in deltas]]:
            part = self._table(kind, k).select("feature", F.struct(*STATE_COLUMNS).alias(f"__r{k}"))
            # Merge joins of sorted buckets: the state is far larger than what a batch touches, and never broadcast.
            found = found.join(part.hint("merge"), "feature", "left")
            row = F.col(f"__r{k}") if k == base else F.coalesce(F.col(f"__r{k}"), row)
        return found.select("feature", row.alias("__row")).where(F.col("__row").isNotNull()).select("feature", "__row.*")

    def slice_for(self, examples: DataFrame, version: int) -> DataFrame:
        touched = exploded(examples, []).where(F.col("feature").isNotNull()).select("feature").distinct()
        # Read several times by a step, so it is written: as many rows as the batch has features.
        return self.save_rows("slice", version + 1, self.rows_of(touched, version))

    # --- writing ---

    def save(self, version: int, state: DataFrame, source: str = "", batch: str = "", **settings) -> DataFrame:
        """A whole state, as a new base."""
        written = self._write_base(version, state)
        size, nonzero = written.agg(F.count(F.lit(1)), F.count_if(F.col("w") != 0.0)).first()
        self._finish(version, size, size, nonzero, source, batch, settings)
        return written

    def save_changes(
        self, version: int, before: DataFrame, after: DataFrame, source: str = "", batch: str = "", **settings
    ) -> DataFrame:
        """The version after ``version`` - 1 in which the rows of ``after`` replace those of ``before`` (``rows_of`` them)."""
        if version == 1:
            return self.save(version, after, source, batch, **settings)
        written = self._write("delta", version, after)
        added = written.agg(F.count(F.lit(1)), F.count_if(F.col("w") != 0.0)).first()
        gone = before.agg(F.count(F.lit(1)), F.count_if(F.col("w") != 0.0)).first()
        old = self.meta().where(F.col("version") == version - 1).first()
        size, nonzero = old["features"] + added[0] - gone[0], old["nonzero"] + added[1] - gone[1]
        self._finish(version, added[0], size, nonzero, source, batch, settings)
        base, deltas = self._parts(version)
        held = self.meta().where(F.col("version") > base).agg(F.sum("written")).first()[0]
        remove_folder(self.spark, self._path("slice", version))
        if len(deltas) >= self.compact_every or held >= self.compact_share * size:
            self.compact()
        return written

    def compact(self) -> None:
        """Write the latest version as a base too; its content stays the same."""
        version = self.latest()
        if not self._parts(version)[1]:
            return
        self._write_base(version, self.load(version))
        self._prune(version)

    def _finish(self, version, written, features, nonzero, source, batch, settings) -> None:
        meta = {"written": written, "features": features, "nonzero": nonzero, "buckets": self.buckets,
                "source": source, "batch_name": batch, **settings}
        self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()]).write.mode("overwrite").parquet(
            self._path("meta", version))
        self._prune(version)

    def _prune(self, latest: int) -> None:
        """Remove what no kept version needs."""
        if self.keep is None:
            return
        needed, _ = self._parts(max(1, latest - self.keep + 1))
        bases = [r[0] for r in self._read("bases").where(F.col("version") < needed).select("version").collect()]
        # Of versions pruned earlier nothing but an old base can be left, so this looks at a few only.
        gone = [("base", k) for k in bases] + [("delta", k) for k in range(min(bases, default=needed), needed + 1)]
        for kind, k in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(kind, k)}")
            remove_folder(self.spark, self._path(kind, k))
        for k in bases:
            remove_folder(self.spark, self._path("bases", k))
