"""A stream source that replays recorded job events at a rate."""

from __future__ import annotations

import bisect
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vendorlens.schemas import JOB_EVENTS


@dataclass
class Piece(InputPartition):
    """Rows [lo, hi) of one row group of a file."""

    file: str
    group: int
    lo: int
    hi: int


class ReplayReader(DataSourceStreamReader):
    """Offsets are numbers of rows in the order of the files' names: what a batch holds follows from its offsets alone, so a restart
    from a checkpoint neither loses nor repeats a row."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.arrow = to_arrow_schema(schema)
        self.rate = float(options.get("rowspersecond", 0))
        self.begin = float(options.get("begin", 0))
        self.store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = self.store.get_file_info(fs.FileSelector(root, recursive=True))
        self.groups: list[tuple[str, int]] = []
        self.ends: list[int] = []
        for file in sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet")):
            with self.store.open_input_file(file) as f:
                head = pq.ParquetFile(f).metadata
            for g in range(head.num_row_groups):
                self.groups.append((file, g))
                self.ends.append((self.ends[-1] if self.ends else 0) + head.row_group(g).num_rows)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        total = self.ends[-1] if self.ends else 0
        due = int(max(0.0, time.time() - self.begin) * self.rate) if self.rate else total
        return {"row": min(total, due)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out, at = [], start["row"]
        while at < end["row"]:
            k = bisect.bisect_right(self.ends, at)
            first = self.ends[k - 1] if k else 0
            stop = min(end["row"], self.ends[k])
            out.append(Piece(*self.groups[k], at - first, stop - first))
            at = stop
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(piece.file) as f:
            rows = pq.ParquetFile(f).read_row_group(piece.group, columns=self.columns)
        yield from rows.slice(piece.lo, piece.hi - piece.lo).cast(self.arrow).combine_chunks().to_batches()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "store"}  # opened anew on each executor

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()


class JobReplay(DataSource):
    """Options: ``path``, a folder of Parquet files of job events; ``rowsPerSecond`` since ``begin`` (seconds since 1970), or
    all rows at once without it."""

    @classmethod
    def name(cls) -> str:
        return "job_replay"

    def schema(self) -> str:
        return JOB_EVENTS

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader({k.lower(): v for k, v in self.options.items()}, schema)


def replayed_jobs(spark: SparkSession, path: str, *, rows_per_second: float | None = None, begin: float | None = None):
    """A stream of the job events in ``path``, at a rate since ``begin`` (now)."""
    spark.dataSource.register(JobReplay)
    source = spark.readStream.format("job_replay").option("path", path)
    if rows_per_second:
        source = source.option("rowsPerSecond", rows_per_second).option("begin", time.time() if begin is None else begin)
    return source.load()
