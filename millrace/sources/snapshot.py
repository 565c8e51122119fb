"""Online snapshots: the newest row of every key, merged by the rows that change.

Keys are hashed into buckets; their number follows the size of the table. A merge writes only rows that are newer than what is stored, as a
delta of their bucket under the merge's version. A bucket whose deltas outgrow ``DELTA_SHARE`` of its base is rewritten, the others' files
stay. The manifest of a version names the folders that make up the snapshot; a merge that dies before its manifest is written leaves the
snapshot as it was, and the next one takes its number. Of rows with equal ``ts`` the one that is greater in its other columns, by name,
is the newer, so merges in any order and repeated merges end with the same rows. One merge runs at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import top_per_group
from ..session import stored
from .files import _paths

ROWS_PER_BUCKET = 1_000_000
DELTA_SHARE = 0.5  # of the rows of a base
_MANIFEST = "buckets int, bucket int, version int, base boolean, rows long"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newness(df: DataFrame, keys: Sequence[str], ts: str) -> Column:
    """What the rows of a key are compared by; columns without an order take no part."""
    others = [c for c, t in sorted(df.dtypes) if c not in (*keys, ts) and "map<" not in t and t != "variant"]
    return F.struct(F.col(ts), *[F.col(c) for c in others])


def _version(spark: SparkSession, path: str) -> int:
    done = _paths(spark, f"{path}/_manifest/*/_SUCCESS")
    return max((int(p.split("/")[-2].split("-")[1]) for p in done), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> list:
    """The folders of a version: a few per bucket."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest/v-{version}").collect()


def _folders(spark: SparkSession, path: str, folders: Sequence) -> DataFrame:
    found = [f"{path}/version={m['version']}/bucket={m['bucket']}" for m in folders]
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*found)


def read(spark: SparkSession, path: str, keys: Sequence[str], ts: str) -> DataFrame:
    """The newest row of every key. Buckets without deltas are read as they are."""
    folders = _manifest(spark, path, _version(spark, path))
    mixed = {m["bucket"] for m in folders if not m["base"]}
    parts = []
    if plain := [m for m in folders if m["bucket"] not in mixed]:
        parts.append(_folders(spark, path, plain).drop("version", "bucket"))
    if mixed:
        rows = _folders(spark, path, [m for m in folders if m["bucket"] in mixed]).drop("version", "bucket")
        parts.append(top_per_group(rows, list(keys), [_newness(rows, keys, ts).desc()], 1))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def merge(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], ts: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Bring new rows into the snapshot; returns its changes: bucket, ``kind`` (base or delta) and rows of every folder written."""
    keys = list(keys)
    version, folders = _version(spark, path), []
    incoming = stored(top_per_group(new, keys, [_newness(new, keys, ts).desc()], 1), "incoming")
    if version:
        folders = _manifest(spark, path, version)
        buckets, held = folders[0]["buckets"], sum(m["rows"] for m in folders)
        changed = stored(_changed(spark, incoming, path, folders, buckets, keys, ts), "changed")
    else:
        changed, held, buckets = incoming, 0, 0
    total = held + changed.count()
    fits = max(1, -(-total // rows_per_bucket))
    version += 1
    if not folders or fits > 2 * buckets:
        whole = changed
        if held:
            whole = top_per_group(read(spark, path, keys, ts).unionByName(changed, allowMissingColumns=True), keys,
                                  [_newness(changed, keys, ts).desc()], 1)
        written = _write(spark, whole, path, version, keys, fits)
        rows = [(fits, b, version, True, n) for b, n in written.items()] or [(fits, 0, version, True, 0)]
        if not written:
            whole.limit(0).write.mode("overwrite").parquet(f"{path}/version={version}/bucket=0")
        return _commit(spark, path, version, rows)
    counts = {r["b"]: r["n"] for r in changed.groupBy(_bucket(keys, buckets).alias("b")).agg(F.count("*").alias("n")).collect()}  # a row a bucket
    base = {m["bucket"]: m["rows"] for m in folders if m["base"]}
    deltas = {b: n + sum(m["rows"] for m in folders if m["bucket"] == b and not m["base"]) for b, n in counts.items()}
    full = [b for b in counts if deltas[b] > DELTA_SHARE * base.get(b, 0)]
    out = changed.withColumn("_full", _bucket(keys, buckets).isin(full)) if full else changed.withColumn("_full", F.lit(False))
    rows = out.filter("NOT _full").drop("_full")
    if full:
        touched = [m for m in folders if m["bucket"] in full]
        fresh = out.filter("_full").drop("_full")
        if touched:
            fresh = _folders(spark, path, touched).drop("version", "bucket").unionByName(fresh, allowMissingColumns=True)
        rows = top_per_group(fresh, keys, [_newness(fresh, keys, ts).desc()], 1).unionByName(rows, allowMissingColumns=True)
    written = _write(spark, rows, path, version, keys, buckets)
    entries = [(buckets, b, version, b in full, n) for b, n in written.items()]
    return _commit(spark, path, version, [tuple(m) for m in folders if m["bucket"] not in full] + entries)


def _changed(spark, incoming: DataFrame, path: str, folders: Sequence, buckets: int, keys: list[str], ts: str) -> DataFrame:
    """The incoming rows that are newer than the stored row of their key, or have none."""
    touched = {r["b"] for r in incoming.select(_bucket(keys, buckets).alias("b")).distinct().collect()}  # a row a bucket
    there = [m for m in folders if m["bucket"] in touched]
    if not there:
        return incoming
    # Only stored rows of incoming keys matter; a small increment is broadcast by its measured size.
    asked = incoming.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    held = _folders(spark, path, there).drop("version", "bucket")
    held = held.join(asked, reduce(and_, [held[k].eqNullSafe(asked[f"_key{i}"]) for i, k in enumerate(keys)]), "left_semi")
    both = held.withColumn("_new", F.lit(False)).unionByName(
        incoming.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    # An equal row is taken as stored.
    order = _newness(both.drop("_new"), keys, ts)
    return top_per_group(both, keys, [order.desc(), F.asc("_new")], 1).filter("_new").drop("_new")


def _write(spark, rows: DataFrame, path: str, version: int, keys: list[str], buckets: int) -> dict[int, int]:
    """Rows per bucket of what was written."""
    target = f"{path}/version={version}"
    rows.withColumn("bucket", _bucket(keys, buckets)).hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("bucket").parquet(target)
    if not _paths(spark, f"{target}/bucket=*"):
        return {}
    return {int(r["bucket"]): r["n"] for r in spark.read.parquet(target).groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def _commit(spark, path: str, version: int, rows: list) -> DataFrame:
    manifest = spark.createDataFrame(rows, _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/v-{version}")
    return manifest.filter((F.col("version") == version) & (F.col("rows") > 0)).select(
        "bucket", F.when(F.col("base"), "base").otherwise("delta").alias("kind"), "rows")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that the newest version does not name; readers of older versions must be done."""
    version = _version(spark, path)
    live = {f"version={m['version']}/bucket={m['bucket']}" for m in _manifest(spark, path, version)}
    dropped = []
    for folder in _paths(spark, f"{path}/version=*/bucket=*"):
        name = "/".join(folder.split("/")[-2:])
        if name not in live and int(name.split("/")[0].split("=")[1]) <= version:
            target = spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            dropped.append(name)
    return dropped
