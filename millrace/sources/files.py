"""File sources: events, CSV rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import EVENT_SCHEMA

CORRUPT = "_corrupt_record"


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on whatever file system the path names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_paths(spark, path))


def detect_source(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(format, path) by the naming rules of the landing folder; None when there is no input."""
    for fmt, name in (("parquet", "events.parquet"), ("jsonl", "events.jsonl")):
        if exists(spark, f"{root}/{name}"):
            return fmt, f"{root}/{name}"
    if not exists(spark, root):
        return None
    if _paths(spark, f"{root}/*.parquet"):
        return "parquet", root
    return ("jsonl", root) if _paths(spark, f"{root}/*") else None


def read_events(spark: SparkSession, root: str, fmt: str = "auto", schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    if fmt == "auto":
        found = detect_source(spark, root)
        if found is None:
            raise FileNotFoundError(f"no event files in {root}")
        fmt, root = found
    if fmt == "parquet":
        return spark.read.parquet(root)
    if fmt in ("jsonl", "json"):
        return read_jsonl(spark, root, schema)
    raise ValueError(f"unsupported format: {fmt}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Fixed schema, no inference pass; broken lines stay visible in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, max_rows: int | None = None) -> DataFrame:
    """Typed CSV. ``max_rows`` is a guard: a larger file is refused, never cut."""
    df = spark.read.csv(path, schema=schema, header=header)
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{path} has more than {max_rows} rows")
    return df


def read_lake_or_raw(spark: SparkSession, lake: str, raw: str, fmt: str = "parquet") -> DataFrame:
    """The lake table when it exists, else the raw files."""
    if exists(spark, lake):
        return spark.read.format(fmt).load(lake)
    return spark.read.parquet(raw)


def json_document_text(content: Column) -> Column:
    """``content``, else ``text``, else the document itself; an array gives one line per item."""
    as_list = F.from_json(content, "array<string>")
    as_object = F.coalesce(F.get_json_object(content, "$.content"), F.get_json_object(content, "$.text"), content)
    return F.when(F.ltrim(content).startswith("["), F.array_join(as_list, "\n")).otherwise(as_object)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Recursive scan of ``.txt``, ``.md`` and ``.json`` files as (doc_id, content, source, timestamp, metadata).

    Files that are not UTF-8 and broken JSON files are skipped; ``unreadable_documents`` lists them.
    """
    return _scan_documents(spark, root).filter("content is not null")


def unreadable_documents(spark: SparkSession, root: str) -> DataFrame:
    """The files that ``read_documents`` skips: (doc_id, source)."""
    return _scan_documents(spark, root).filter("content is null").select("doc_id", "source")


def _scan_documents(spark: SparkSession, root: str) -> DataFrame:
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", "*.{txt,md,json,TXT,MD,JSON}").load(root)
    )
    scheme_free = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    relative = F.regexp_replace(scheme_free, "^.*?" + F_quote(root) + "/+", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    extension = F.regexp_extract(F.lower("path"), r"\.([a-z]+)$", 1)
    return raw.select(
        F.substring(F.md5(scheme_free), 1, 12).alias("doc_id"),
        F.when(extension != "json", text).when(F.get_json_object(text, "$").isNotNull(), json_document_text(text)).alias("content"),
        relative.alias("source"),
        F.col("modificationTime").alias("timestamp"),
        F.create_map(
            F.lit("filename"), F.regexp_extract("path", r"([^/]+)$", 1), F.lit("extension"), F.concat(F.lit("."), extension)
        ).alias("metadata"),
    )


def F_quote(root: str) -> str:
    """A path as a literal inside a Java pattern."""
    bare = root.split("://", 1)[-1].rstrip("/")
    return r"\Q" + bare.lstrip("/") + r"\E"
