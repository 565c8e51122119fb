"""Day-partitioned Parquet tables: idempotent writes, compaction, retention."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .files import _paths, exists


def write_table(df: DataFrame, path: str, partition_by: str = "dt", mode: str = "append", files_per_partition: int = 1) -> None:
    """Partitioned write. ``overwrite`` replaces only the partitions present in ``df``.

    Rows are spread over ``files_per_partition`` tasks per partition value, so a heavy day does not end in one task;
    AQE splits what is still too large.
    """
    if files_per_partition > 1:
        salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(files_per_partition))
        spread = df.withColumn("_salt", salt).repartition(partition_by, "_salt").drop("_salt")
    else:
        spread = df.hint("rebalance", partition_by)
    (spread.write.mode(mode).partitionBy(partition_by).option("partitionOverwriteMode", "dynamic").parquet(path))


def read_table(spark: SparkSession, path: str, merge_schema: bool = False, day: str = "dt") -> DataFrame:
    """The day stays text, as it was written; filters on it still prune partitions. ``merge_schema`` reads tables whose
    columns grew over time."""
    df = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    return df.withColumn(day, F.col(day).cast("string")) if day in df.columns else df


# A file below this share of the target counts as small.
TARGET_BYTES, SMALL_SHARE = 128 << 20, 0.5


def small_files(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, column: str = "dt") -> DataFrame:
    """(folder, file, length, bin): small files of each day folder, dealt by running size into bins of about the target; a bin holds two files
    at least. The listing reads names and sizes only."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = listed.select(F.regexp_extract("path", f"/({column}=[^/]*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    files = files.filter((F.col("folder") != "") & (F.col("length") < int(target_bytes * SMALL_SHARE)))
    before = F.sum("length").over(Window.partitionBy("folder").orderBy("length", "file").rowsBetween(Window.unboundedPreceding, -1))
    binned = files.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / target_bytes).cast("long"))
    return binned.withColumn("_n", F.count("*").over(Window.partitionBy("folder", "bin"))).filter("_n > 1").drop("_n")


def compact_files(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, column: str = "dt") -> DataFrame:
    """Rewrite the small files of every day into files of about the target size; returns (folder, bin, files, bytes) of what was joined.

    Other files are neither read nor touched. The new files are written aside with the list of those they replace; then they are moved in and
    the old ones deleted. If the driver is lost in between, the next call finishes the swap, and a rewrite that was not complete is dropped.
    Readers should wait for the swap. The table has one partition column.
    """
    finish_compaction(spark, path)
    work = f"{path}/_compact-{uuid.uuid4().hex[:12]}"
    small_files(spark, path, target_bytes, column).withColumn("id", F.md5(F.concat_ws("/", "folder", F.col("bin").cast("string")))).write.parquet(f"{work}/plan")
    plan = spark.read.parquet(f"{work}/plan")
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.option("mergeSchema", "true").parquet(path).filter(F.col("_metadata.file_size") < int(target_bytes * SMALL_SHARE))
    rows = rows.withColumn("_path", name).drop(column).withColumn("_folder", F.element_at(F.split("_path", "/"), -2)).withColumn(
        "_file", F.element_at(F.split("_path", "/"), -1))
    picked = plan.select(F.col("folder").alias("_folder"), F.col("file").alias("_file"), F.col("id").alias("_bin"))
    joined = rows.join(picked, ["_folder", "_file"]).drop("_folder", "_file", "_path")
    joined.repartition("_bin").write.partitionBy("_bin").parquet(f"{work}/data")
    report = stored(plan.groupBy("folder", "bin").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")), "compacted")
    finish_compaction(spark, path)
    return report


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Swap what a rewrite has completed, drop what it has not. Each step can be repeated."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for work in _paths(spark, f"{path}/_compact-*"):
        store = fs_path(work).getFileSystem(spark._jsc.hadoopConfiguration())
        if exists(spark, f"{work}/data/_SUCCESS"):
            plan = spark.read.parquet(f"{work}/plan")
            tag = work.rsplit("-", 1)[1]
            # One folder's names at a time; only names and sizes pass through here.
            for r in plan.select("folder", "id").distinct().toLocalIterator():
                for i, part in enumerate(_paths(spark, f"{work}/data/_bin={r['id']}/*.parquet")):
                    store.rename(fs_path(part), fs_path(f"{path}/{r['folder']}/part-{tag}-{r['id']}-{part.rsplit('/', 1)[1]}"))
            for r in plan.select("folder", "file").toLocalIterator():
                store.delete(fs_path(f"{path}/{r['folder']}/{r['file']}"), False)
        store.delete(fs_path(work), True)


def drop_expired(spark: SparkSession, path: str, as_of: str, days: int, column: str = "dt") -> list[str]:
    """Delete the day folders of a table that are older than the retention period; returns the days dropped."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = (dt.date.fromisoformat(as_of) - dt.timedelta(days=days)).isoformat()
    dropped = []
    for status in store.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}=") and name.split("=", 1)[1] < first:
            store.delete(status.getPath(), True)
            dropped.append(name.split("=", 1)[1])
    return sorted(dropped)


def retain(df: DataFrame, as_of: str, days: int, column: str = "dt") -> DataFrame:
    """Partitions inside the retention period; the predicate prunes on the partition column."""
    return df.filter(F.col(column) >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"))


# Days kept per layer.
RETENTION_DAYS = {"bronze": 90, "silver": 365, "gold": 1095}


def apply_retention(spark: SparkSession, root: str, as_of: str, column: str = "dt") -> dict[str, list[str]]:
    """Delete the expired day folders of every layer below ``root``; returns the days dropped per layer."""
    return {layer: drop_expired(spark, f"{root}/{layer}", as_of, days, column)
            for layer, days in RETENTION_DAYS.items() if exists(spark, f"{root}/{layer}")}


def split_valid(df: DataFrame, errors: Column) -> DataFrame:
    """Both halves in one partitioned frame: ``layer`` is ``silver`` or ``quarantine``."""
    return df.withColumn("violations", errors).withColumn(
        "layer", F.when(F.size("violations") == 0, "silver").otherwise("quarantine"))
