"""Compaction by file sizes, retention by layer, and snapshots merged by changed rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import registry
from millrace.sources import lake, snapshot

KEYS = ["k"]


def day_files(path, day):
    return {p.name: p.stat().st_size for p in (path / f"dt={day}").glob("*.parquet")}


@pytest.fixture
def lake_path(spark, tmp_path):
    """A day of forty small files, a day with one large and one small file, a day of one file."""
    path = tmp_path / "lake"
    noise = F.sha2(F.col("id").cast("string"), 256).alias("x")
    spark.range(0, 4000, 1, 40).select("id", noise, F.lit("2024-01-01").alias("dt")).write.partitionBy("dt").parquet(str(path))
    for start, n, day in ((10000, 3000, "2024-01-02"), (20000, 100, "2024-01-02"), (30000, 100, "2024-01-03")):
        spark.range(start, start + n, 1, 1).select("id", noise, F.lit(day).alias("dt")).write.mode("append").partitionBy("dt").parquet(str(path))
    return path


def rows_of(spark, path):
    return sorted((r.id, r.x, r.dt) for r in lake.read_table(spark, str(path)).collect())


def test_small_files_become_few_and_others_stay(spark, lake_path):
    before, rows = {d: day_files(lake_path, d) for d in ("2024-01-01", "2024-01-02", "2024-01-03")}, rows_of(spark, lake_path)
    assert len(before["2024-01-01"]) == 40
    target = 100_000
    report = lake.compact_files(spark, str(lake_path), target).collect()
    after = day_files(lake_path, "2024-01-01")
    assert {r.folder for r in report} == {"dt=2024-01-01"} and sum(r.files for r in report) == 40
    assert len(after) == len(report) < 6 and all(r.bytes < target * (1 + lake.SMALL_SHARE) for r in report)
    assert day_files(lake_path, "2024-01-02") == before["2024-01-02"] and day_files(lake_path, "2024-01-03") == before["2024-01-03"]
    assert rows_of(spark, lake_path) == rows
    assert not list(lake_path.glob("_compact-*"))


def test_rewrite_that_died_is_finished_or_dropped(spark, lake_path, monkeypatch):
    rows, finish = rows_of(spark, lake_path), lake.finish_compaction
    calls = []
    monkeypatch.setattr(lake, "finish_compaction", lambda *a: calls.append(a))  # the driver is lost before the swap
    lake.compact_files(spark, str(lake_path), 100_000)
    assert len(calls) == 2 and list(lake_path.glob("_compact-*")) and rows_of(spark, lake_path) == rows
    finish(spark, str(lake_path))
    assert rows_of(spark, lake_path) == rows and len(day_files(lake_path, "2024-01-01")) < 6
    (lake_path / "_compact-dead" / "plan").mkdir(parents=True)
    monkeypatch.setattr(lake, "finish_compaction", finish)
    assert lake.compact_files(spark, str(lake_path), 1000).count() == 0
    assert rows_of(spark, lake_path) == rows and not list(lake_path.glob("_compact-*"))


def test_each_layer_keeps_its_days(spark, tmp_path):
    days = ["2020-12-31", "2021-01-02", "2023-01-01", "2023-01-02", "2023-10-02", "2023-10-05", "2024-01-01"]
    for layer in ("bronze", "silver", "gold"):
        lake.write_table(spark.createDataFrame([(i, d) for i, d in enumerate(days)], "x int, dt string"), str(tmp_path / layer))
    dropped = lake.apply_retention(spark, str(tmp_path), "2024-01-01")
    assert dropped == {"bronze": days[:4] + days[4:5], "silver": days[:2], "gold": days[:1]}
    left = lambda layer: sorted(r.dt for r in lake.read_table(spark, str(tmp_path / layer)).collect())
    assert (left("bronze"), left("silver"), left("gold")) == (days[5:], days[2:], days[1:])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, ts int, v string")


def test_snapshot_equals_a_dictionary(spark, tmp_path):
    """Random merges with ties, null keys and times, over few and many buckets."""
    rng, path, want = random.Random(5), str(tmp_path / "s"), {}
    order = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""))
    for n in (40, 3, 60, 1, 30):
        rows = [(rng.choice([None, *range(50)]), rng.choice([None, *range(8)]), rng.choice([None, "a", "b", "c"])) for _ in range(n)]
        snapshot.merge(spark, frame(spark, rows), path, KEYS, "ts", rows_per_bucket=6)
        for r in rows:
            if r[0] not in want or order(r) > order(want[r[0]]):
                want[r[0]] = r
        got = [tuple(r) for r in snapshot.read(spark, path, KEYS, "ts").select("k", "ts", "v").collect()]
        assert len(got) == len(want) and {r[0]: r for r in got} == want


def test_merge_leaves_other_files_alone(spark, tmp_path):
    path = tmp_path / "s"
    rows = spark.range(400).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("ts"), F.lit("a").alias("v"))
    first = snapshot.merge(spark, rows, str(path), KEYS, "ts", rows_per_bucket=50).collect()
    assert len(first) == 8 and {r.kind for r in first} == {"base"}
    files = {str(p): p.stat().st_mtime_ns for p in path.glob("version=1/**/*.parquet")}
    one = snapshot.merge(spark, frame(spark, [(7, 2, "b"), (8, 0, "old"), (9, 1, "a")]), str(path), KEYS, "ts", rows_per_bucket=50).collect()
    assert [(r.kind, r.rows) for r in one] == [("delta", 1)]  # an older and an equal row change nothing
    assert {str(p): p.stat().st_mtime_ns for p in path.glob("version=1/**/*.parquet")} == files
    assert snapshot.merge(spark, frame(spark, [(7, 2, "b")]), str(path), KEYS, "ts", rows_per_bucket=50).count() == 0
    many = snapshot.merge(spark, rows.withColumn("ts", F.lit(3)), str(path), KEYS, "ts", rows_per_bucket=50).collect()
    assert {r.kind for r in many} == {"base"} and sum(r.rows for r in many) == 400
    assert snapshot.read(spark, str(path), KEYS, "ts").filter("ts = 3").count() == 400
    assert len(snapshot.vacuum(spark, str(path))) == 9 and snapshot.read(spark, str(path), KEYS, "ts").count() == 400


def test_merge_without_a_manifest_does_not_count(spark, tmp_path):
    path = tmp_path / "s"
    snapshot.merge(spark, frame(spark, [(1, 1, "a")]), str(path), KEYS, "ts")
    spark.createDataFrame([(1, 9, "lost")], "k int, ts int, v string").write.parquet(str(path / "version=2" / "bucket=0"))
    assert snapshot.read(spark, str(path), KEYS, "ts").first().v == "a"
    snapshot.merge(spark, frame(spark, [(2, 1, "b")]), str(path), KEYS, "ts")
    assert sorted(r.v for r in snapshot.read(spark, str(path), KEYS, "ts").collect()) == ["a", "b"]


def test_empty_and_wider_merges(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshot.merge(spark, frame(spark, []), path, KEYS, "ts")
    assert snapshot.read(spark, path, KEYS, "ts").count() == 0
    snapshot.merge(spark, frame(spark, [(1, 1, "a"), (2, 1, "b")]), path, KEYS, "ts")
    snapshot.merge(spark, frame(spark, [(1, 2, "c")]).withColumn("w", F.lit(5)), path, KEYS, "ts")
    assert {(r.k, r.v, r.w) for r in snapshot.read(spark, path, KEYS, "ts").collect()} == {(1, "c", 5), (2, "b", None)}


def test_rollback_to_a_given_version_and_its_refusals(spark):
    rows = [(m, v, "Production" if v == live else "None") for m, live, all_v in
            (("a", 3, (1, 2, 3, 5)), ("b", 3, (1, 2, 3)), ("c", 3, (2, 3)), ("first", 1, (1, 2)), ("up", 1, (1, 2)), ("none", 0, (1,))) for v in all_v]
    versions = spark.createDataFrame(rows, "model_name string, version int, stage string")
    asked = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1), ("up", 2), ("none", 1), ("other", 4)], "model_name string, requested int")
    got = {r.model_name: (r.target_version, r.reason) for r in registry.rollback_targets(versions, asked).collect()}
    assert got == {"a": (1, "rollback"), "b": (None, "already in production"), "c": (None, "unknown version"), "first": (None, "no previous version"),
                   "up": (2, "rollback"), "none": (None, "no production version")}
