"""A log table as a stream with offsets of its own: latest offset, a limit per batch, commit, replay."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import join

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType

NAME = "ordered_log"
_LOWEST = -(1 << 63)


@dataclass
class Piece(InputPartition):
    """Rows of one row group whose order lies in (after, last]; the steps of these rows begin behind ``first`` with number ``steps``."""

    file: str
    group: int
    after: int
    last: int
    first: int
    steps: int

    def __post_init__(self) -> None:
        super().__init__((self.file, self.group))


class OffsetFile:
    """How far a reader has planned to read and how far what it read is known to be done, in a small file that is replaced whole."""

    def __init__(self, uri: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(uri)

    def read(self) -> dict[str, int]:
        # Of a replacement that was cut short, either the old or the new file is whole.
        for path in (self.path, f"{self.path}.new"):
            if self.files.get_file_info(path).type == fs.FileType.File:
                with self.files.open_input_stream(path) as f:
                    try:
                        return json.loads(f.read())
                    except ValueError:
                        continue
        return {}

    def write(self, offsets: dict[str, int]) -> None:
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(f"{self.path}.new") as f:
            f.write(json.dumps(offsets).encode())
        self.files.move(f"{self.path}.new", self.path)


class LogReader(DataSourceStreamReader):
    def __init__(
        self, path: str, order: str, step: int, offsets: str, columns: list[str], together: int = 1, number: str | None = None,
    ) -> None:
        self.path, self.order, self.step, self.columns = path, order, step, columns
        self.together, self.number = together, number
        self.offsets = OffsetFile(offsets)
        self.seen: dict[str, list[tuple[int, int, int]]] = {}  # file: (group, least, most) of those with rows

    def _groups(self) -> list[tuple[str, int, int, int]]:
        """(file, group, least, most); footers of files are read once."""
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        for f in found:
            if f.type != fs.FileType.File or not f.path.endswith(".parquet") or f.path in self.seen:
                continue
            with files.open_input_file(f.path) as source:
                meta = pq.ParquetFile(source).metadata
                column = meta.schema.names.index(self.order)
                stats = [(k, meta.row_group(k).column(column).statistics) for k in range(meta.num_row_groups)]
                self.seen[f.path] = [(k, s.min, s.max) for k, s in stats if s is not None and s.has_min_max]
        return [(f, *group) for f, groups in sorted(self.seen.items()) for group in groups]

    def _known(self, name: str) -> dict:
        """The offset that was ``planned`` or ``done`` last, as it was then: one that differs would make a batch without rows."""
        known = self.offsets.read()
        at = known.get(name, _LOWEST)
        return {"at": at, "first": known.get(f"{name}_first", at), "steps": known.get(f"{name}_steps", 0)}

    def _note(self, name: str, offset: dict) -> None:
        known = self.offsets.read()
        at = offset["at"]
        if at >= known.get(name, _LOWEST):
            more = {name: at, f"{name}_first": offset.get("first", at), f"{name}_steps": offset.get("steps", 0)}
            self.offsets.write({**known, **more})

    def initialOffset(self) -> dict:
        return self._known("done")

    def latestOffset(self) -> dict:
        """``at``: the last of the order that is read; ``first``: behind which the new steps begin; ``steps``: how many are read then."""
        before = max(self._known("planned"), self._known("done"), key=lambda offset: offset["at"])
        at = before["at"]
        groups = sorted((low, most) for _, _, low, most in self._groups() if most > at)
        if not groups:
            return before
        # Gaps in the order are skipped, if a step begins in one; so steps are read together up to the first such gap.
        first = max(at, groups[0][0] - 1)
        end, last = first, max(most for _, most in groups)
        reach = first  # where the groups that begin before it end
        for low, most in groups:
            if low - 1 > reach:
                # The gap (reach, low - 1) is skipped from the first end of a step in it on.
                border = first + -(-(reach - first) // self.step) * self.step
                if border < low - 1:
                    last = min(last, border)
                    break
            reach = max(reach, most)
        end = min(first + self.step * self.together, last)
        return {"at": end, "first": first, "steps": before["steps"] - (first - end) // self.step}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        after, last = start["at"], end["at"]
        # From now on the next batch begins behind this one, also in a reader that is started anew.
        self._note("planned", end)
        first = end.get("first", after)
        steps = end.get("steps", 0) + (first - last) // self.step
        return [Piece(f, k, after, last, first, steps) for f, k, low, most in self._groups() if low <= last and most > after]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.file) as source:
            wanted = {c for c in (*self.columns, self.order) if c != self.number}
            rows = pq.ParquetFile(source).read_row_group(partition.group, columns=list(wanted))
        at = rows.column(self.order)
        mine = pc.and_(pc.greater(at, partition.after), pc.less_equal(at, partition.last))
        rows = rows.filter(mine)
        if self.number in self.columns:
            place = pc.divide(pc.subtract(rows.column(self.order).cast(pa.int64()), partition.first + 1), self.step)
            rows = rows.append_column(self.number, pc.add(place, partition.steps).cast(pa.int32()))
        yield from rows.select(self.columns).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        self._note("done", end)


class OrderedLog(DataSource):
    """Parquet files with a whole-number column that only grows as the log does.

    Options: ``path``, ``order``, ``step`` (how far of the order a step reaches), ``offsets`` (a file of this reader's own),
    ``together`` (how many waiting steps a batch reads at most, 1 without it), ``number`` (a column for the number of a row's step, from 0).
    Files and offsets lie where pyarrow can read them. A row without an order is not part of the log. A batch is the rows in
    (start, end], whatever came later, so one that was not committed is read again with the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema) -> LogReader:
        o = self.options
        return LogReader(
            o["path"], o["order"], int(o["step"]), o["offsets"], [f.name for f in schema.fields], int(o.get("together", 1)), o.get("number"))


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def ordered_log(
    spark: SparkSession, path: str, order: str, step: int, folder: str, together: int = 1, number: str | None = None,
) -> DataFrame:
    """The log as a streaming table; ``folder`` keeps the reader's offsets. ``number`` names a column for the number of a row's step."""
    spark.dataSource.register(OrderedLog)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.format(NAME).option("path", _uri(path)).option("order", order).option("step", step)
    if number:
        schema, reader = StructType([*schema.fields, StructField(number, IntegerType())]), reader.option("number", number)
    reader = reader.schema(schema).option("together", together)
    return reader.option("offsets", _uri(join(folder, "offsets.json"))).load()


def committed(folder: str) -> dict[str, int]:
    """``planned`` and ``done`` offsets of the reader that keeps them in a folder."""
    return OffsetFile(_uri(join(folder, "offsets.json"))).read()
