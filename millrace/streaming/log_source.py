"""A partitioned log in the shared folder and a stream source over it, with offsets of its own per partition.

A log is a folder ``partition=<p>/segment=<s>`` of Parquet files; segment ``s`` holds the records of offsets ``s * size`` up to
``(s + 1) * size``. Offsets of a partition rise by one without gaps, so a range of offsets names its folders and the number of records
it must hold, and the newest segment alone tells where a partition ends. Files have small row groups, so a trigger reads the footers of a
few files to see where partitions end, and then only the row groups that hold its offsets, however long a segment is.

Options of the source (``format("millrace_log")``): ``path``; ``segmentRecords``, as published; ``startingOffsets``: ``earliest``,
``latest`` or JSON like ``{"0": 17}`` (other partitions from their beginning); ``maxOffsetsPerTrigger``: records a trigger takes at most,
dealt to the partitions in proportion to what waits in each; ``failOnDataLoss``: whether records that should be there but are not stop
the stream or are passed over; ``checkpoint``: the query's checkpoint folder, from which a restarted query takes up its offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SEGMENT_RECORDS = 10_000
MAX_OFFSETS_PER_TRIGGER = 10_000
#: Bytes of a row group before compression: some thousand records of a few hundred bytes.
ROW_GROUP_BYTES = 1 << 20
SCHEMA = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]
_TYPES = pa.schema([("key", pa.string()), ("value", pa.string()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()),
                    ("timestamp", pa.timestamp("us", tz="UTC"))])


def publish_log(messages: DataFrame, path: str, segment_records: int = SEGMENT_RECORDS) -> None:
    """Append messages that carry ``partition`` and ``offset``. A segment is written by one task, in order."""
    placed = messages.select(*[F.col(c) for c in _COLUMNS], F.col("partition").alias("p"), F.floor(F.col("offset") / segment_records).alias("segment"))
    (placed.repartition("p", "segment").sortWithinPartitions("p", "segment", "offset")
     .withColumnsRenamed({"partition": "partition_no", "p": "partition"}).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES)
     .partitionBy("partition", "segment").parquet(path))


def _numbers(files, path: str, name: str) -> list[int]:
    """The values of the folders ``<name>=<value>`` of a path."""
    found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name.split("=", 1)[1]) for f in found if f.base_name.startswith(f"{name}="))


def _files(files, folder: str) -> list[str]:
    """The files of a segment; one appended to in several runs has several."""
    return [f.path for f in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]


def _bounds(files, folder: str, begin: int, end: int) -> tuple[int, int] | None:
    """The least and the greatest offset of a segment within ``begin`` up to ``end``, from the footers of its files.

    A row group without statistics, or with offsets outside, is looked at by its offsets alone.
    """
    found: list[int] = []
    for name in _files(files, folder):
        with files.open_input_file(name) as stream:
            file = pq.ParquetFile(stream)
            column = file.schema_arrow.names.index("offset")
            for group in range(file.num_row_groups):
                s = file.metadata.row_group(group).column(column).statistics
                if s is not None and s.has_min_max and begin <= s.min and s.max < end:
                    found += [s.min, s.max]
                else:
                    found += [o for o in file.read_row_group(group, ["offset"]).column(0).to_pylist() if o is not None and begin <= o < end]
    return (min(found), max(found)) if found else None


def _segment(files, folder: str, begin: int, end: int) -> pa.Table | None:
    """The records of a segment from offset ``begin`` up to ``end``: only row groups that hold some are read."""
    parts = []
    for name in _files(files, folder):
        t = pq.read_table(name, filesystem=files, partitioning=None, filters=[("offset", ">=", begin), ("offset", "<", end)])
        parts.append(t.rename_columns(["partition" if c == "partition_no" else c for c in t.column_names]).select(_COLUMNS).cast(_TYPES))
    return pa.concat_tables(parts).sort_by("offset") if parts else None


class Range(InputPartition):
    def __init__(self, partition: int, begin: int, end: int):
        self.partition, self.begin, self.end = partition, begin, end


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.size = low["path"], int(low.get("segmentrecords", SEGMENT_RECORDS))
        self.starting, self.cap = low.get("startingoffsets", "earliest"), int(low.get("maxoffsetspertrigger", MAX_OFFSETS_PER_TRIGGER))
        self.strict = low.get("failondataloss", "true").lower() != "false"
        self.checkpoint = low.get("checkpoint")
        self.now: dict[str, int] | None = None

    def _ends(self, newest: bool) -> dict[str, int]:
        """Per partition, the offset after its newest record or that of its oldest one: the footers of one segment each are read."""
        files, root = pafs.FileSystem.from_uri(self.path)
        out = {}
        for p in _numbers(files, root, "partition"):
            for s in sorted(_numbers(files, f"{root}/partition={p}", "segment"), reverse=newest):
                bounds = _bounds(files, f"{root}/partition={p}/segment={s}", s * self.size, (s + 1) * self.size)
                if bounds:
                    out[str(p)] = bounds[1] + 1 if newest else bounds[0]
                    break
        return out

    def initialOffset(self) -> dict:
        if self.starting == "latest":
            return self._ends(True)
        first = self._ends(False)
        return first if self.starting == "earliest" else first | {str(k): int(v) for k, v in json.loads(self.starting).items()}

    def _resumed(self) -> dict | None:
        """The offsets that the query planned last, from its checkpoint."""
        if not self.checkpoint:
            return None
        files, root = pafs.FileSystem.from_uri(self.checkpoint)
        found = files.get_file_info(pafs.FileSelector(f"{root}/offsets", allow_not_found=True))
        batches = [f for f in found if f.base_name.isdigit()]
        if not batches:
            return None
        with files.open_input_stream(max(batches, key=lambda f: int(f.base_name)).path) as f:
            return json.loads(f.read().decode().strip().splitlines()[-1])

    def latestOffset(self) -> dict:
        """Where the next trigger may read to: at most ``cap`` records beyond what was planned last."""
        if self.now is None:
            self.now = self._resumed() or self.initialOffset()
        ends = self._ends(True)
        first = self._ends(False) if set(ends) - set(self.now) else {}
        start = {p: self.now.get(p, first.get(p, 0)) for p in ends} | {p: o for p, o in self.now.items() if p not in ends}
        waiting = {p: max(0, ends.get(p, o) - o) for p, o in start.items()}
        total = sum(waiting.values())
        if total > self.cap:
            taken = {p: self.cap * n // total for p, n in waiting.items()}
            left = self.cap - sum(taken.values())
            for p in sorted(waiting, key=lambda p: (taken[p] - waiting[p], p)):  # the remainder goes where most waits
                if left and taken[p] < waiting[p]:
                    taken[p], left = taken[p] + 1, left - 1
            waiting = taken
        self.now = {p: start[p] + waiting[p] for p in start}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task per segment."""
        missing = set(end) - set(start)
        first = self._ends(False) if missing else {}
        out: list[InputPartition] = []
        for p, to in end.items():
            at = start.get(p, first.get(p, 0))
            while at < to:
                stop = min(to, (at // self.size + 1) * self.size)
                out.append(Range(int(p), at, stop))
                at = stop
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(self.path)
        p, begin, end = partition.partition, partition.begin, partition.end
        found = _segment(files, f"{root}/partition={p}/segment={begin // self.size}", begin, end)
        held = found.num_rows if found is not None else 0
        if self.strict and held < end - begin:
            raise RuntimeError(f"data loss: {end - begin - held} records of partition {p} between offsets {begin} and {end} are gone")
        if held:
            yield from found.combine_chunks().to_batches(max_chunksize=1000)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, checkpoint: str | None = None, **options: str | int | bool) -> DataFrame:
    """A stream over a log. Pass the query's checkpoint folder, so that a restart goes on where it ended."""
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format("millrace_log").option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return (reader.option("checkpoint", checkpoint) if checkpoint else reader).load()
