"""The stream source over a partitioned log: offsets, caps, restarts, lost records."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.streaming import log_source, sinks
from millrace.streaming.log_source import LogReader

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def messages(spark, sizes, first=0):
    return spark.createDataFrame([(f"k{o}", None if o % 7 == 0 else f"v{p}-{o}", "t", p, o, T0 + dt.timedelta(seconds=o))
                                  for p, n in sizes.items() for o in range(first, first + n)], SCHEMA)


def reader(path, **options):
    return LogReader({"path": path, "segmentRecords": "10", **{k: str(v) for k, v in options.items()}})


def test_offsets_and_shares_of_the_cap(spark, tmp_path):
    path = str(tmp_path / "log")
    log_source.publish_log(messages(spark, {0: 90, 1: 10, 2: 1}), path, 10)
    assert reader(path).initialOffset() == {"0": 0, "1": 0, "2": 0}
    assert reader(path, startingOffsets="latest").initialOffset() == {"0": 90, "1": 10, "2": 1}
    assert reader(path, startingOffsets=json.dumps({"0": 40})).initialOffset() == {"0": 40, "1": 0, "2": 0}
    r = reader(path, maxOffsetsPerTrigger=20)
    seen = [r.initialOffset()]
    while not seen[1:] or seen[-1] != seen[-2]:
        seen.append(dict(r.latestOffset()))
    steps = [sum(b.values()) - sum(a.values()) for a, b in zip(seen, seen[1:])]
    assert steps == [20, 20, 20, 20, 20, 1, 0] and seen[-1] == {"0": 90, "1": 10, "2": 1}
    assert seen[1]["0"] >= 17 and all(a[p] <= b[p] for a, b in zip(seen, seen[1:]) for p in a)
    parts = r.partitions({"0": 5, "1": 0, "2": 1}, {"0": 25, "1": 3, "2": 1})
    assert [(x.partition, x.begin, x.end) for x in parts] == [(0, 5, 10), (0, 10, 20), (0, 20, 25), (1, 0, 3)]
    assert LogReader({"path": str(tmp_path / "none")}).initialOffset() == {}


def drained(spark, path, checkpoint, out, **options):
    stream = log_source.read_log(spark, path, checkpoint, segmentRecords=10, **options)
    ended = sinks.run_to_end(stream.writeStream.format("parquet").option("path", out), checkpoint)
    return [p.numInputRows for p in ended.recentProgress if p.numInputRows]


def test_restart_goes_on_where_it_ended(spark, tmp_path):
    path, checkpoint, out = (str(tmp_path / n) for n in ("log", "ck", "out"))
    log_source.publish_log(messages(spark, {0: 35, 1: 5}), path, 10)
    assert drained(spark, path, checkpoint, out, maxOffsetsPerTrigger=15) == [15, 15, 10]
    # More records, some in a segment that is there already, and a new partition.
    log_source.publish_log(messages(spark, {0: 8}, 35).unionByName(messages(spark, {4: 12})), path, 10)
    assert drained(spark, path, checkpoint, out, maxOffsetsPerTrigger=15) == [15, 5]
    got = spark.read.parquet(out)
    want = messages(spark, {0: 43, 1: 5, 4: 12})
    assert sorted(map(tuple, got.select("partition", "offset", "key", "timestamp").collect())) == sorted(map(tuple, want.select("partition", "offset", "key", "timestamp").collect()))
    assert got.filter("value is null").count() == want.filter("value is null").count()
    assert drained(spark, path, checkpoint, out) == []


@pytest.mark.parametrize("lost", ["offset between 10 and 19", "offset = 13"])
def test_lost_records_stop_the_stream_or_are_passed_over(spark, tmp_path, lost):
    """A whole segment, and one record of a segment."""
    path = str(tmp_path / "log")
    log_source.publish_log(messages(spark, {0: 30, 1: 10}).filter(~(F.expr(lost) & (F.col("partition") == 0))), path, 10)
    left = spark.read.parquet(path).count()
    drained(spark, path, str(tmp_path / "a"), str(tmp_path / "tolerant"), failOnDataLoss=False)
    assert spark.read.parquet(str(tmp_path / "tolerant")).count() == left
    with pytest.raises(StreamingQueryException, match="data loss"):
        drained(spark, path, str(tmp_path / "b"), str(tmp_path / "strict"))


def test_ends_come_from_footers(spark, tmp_path, monkeypatch):
    """Where partitions begin and end is known without reading records, as a trigger asks that every time."""
    path = str(tmp_path / "log")
    log_source.publish_log(messages(spark, {0: 25, 1: 7}, 3), path, 10)
    monkeypatch.setattr(log_source, "_segment", None)
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", None)
    assert reader(path).initialOffset() == {"0": 3, "1": 3}
    assert reader(path, startingOffsets="latest").initialOffset() == {"0": 28, "1": 10}


def test_ends_without_statistics_and_with_foreign_offsets(tmp_path):
    folder = tmp_path / "log" / "partition=0" / "segment=1"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"offset": pa.array([14, 12, None], pa.int64())}), folder / "a.parquet", write_statistics=False)
    pq.write_table(pa.table({"offset": pa.array([99, 16, 11], pa.int64())}), folder / "b.parquet")
    pq.write_table(pa.table({"offset": pa.array([], pa.int64())}), folder / "c.parquet")
    path = str(tmp_path / "log")
    assert reader(path).initialOffset() == {"0": 11}
    assert reader(path, startingOffsets="latest").initialOffset() == {"0": 17}


def test_long_segments_have_small_row_groups(spark, tmp_path):
    """A trigger reads the row groups that hold its offsets, a few thousand records, not the whole segment."""
    path = str(tmp_path / "log")
    rows = spark.range(30_000).select(F.lit("k").alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("value"), F.lit("t").alias("topic"),
                                      F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(T0).alias("timestamp"))
    log_source.publish_log(rows, path, 30_000)
    [name] = (tmp_path / "log" / "partition=0" / "segment=0").glob("*.parquet")
    meta = pq.ParquetFile(name).metadata
    assert meta.num_row_groups >= 4 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) < 10_000
    [whole] = reader(path, segmentRecords=30_000).partitions({"0": 12_345}, {"0": 22_345})
    got = pa.Table.from_batches(list(reader(path, segmentRecords=30_000).read(whole)))
    assert got.column("offset").to_pylist() == list(range(12_345, 22_345))
