"""Event decoding, validation and normalisation. Pure ``DataFrame -> DataFrame``: used unchanged by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# The wire contract of an event.
EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
REQUIRED_FIELDS = ("id", "timestamp", "user_id", "product_id", "price", "quantity", "location")
CHANNELS = ("web", "mobile", "api", "pos")
MAX_METADATA_BYTES = 4096

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Output column orders of the streaming and the batch table.
STREAM_COLUMNS = (
    "id", "event_timestamp", "dt", "event_hour", "kafka_offset", "kafka_partition", "kafka_timestamp",
    "user_id", "product_id", "price", "quantity", "total_amount", "location", "city", "country", "region",
    "channel", "device_type", "session_id", "processed_at", "processing_date",
)
BATCH_COLUMNS = (
    "id", "event_timestamp", "dt", "user_id", "product_id", "price", "quantity", "total_amount",
    "location", "city", "country", "channel", "device_type", "session_id", "metadata", "processed_at", "processing_date",
)


def decode_envelope(df: DataFrame) -> DataFrame:
    """Broker records -> typed events; broker columns keep a ``kafka_`` prefix.

    The record is expanded by a generator: filters on its fields stay above it, so each record is parsed once instead of
    once per predicate.
    """
    parsed = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    return df.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.inline(F.array(parsed)),
    )


def _message(condition: Column, text: Column) -> Column:
    return F.when(condition, text)


def violations() -> Column:
    """Every broken rule of a record as text, in rule order."""
    missing = [
        _message(F.col(f).isNull(), F.lit(f"Missing required field: {f}")) for f in REQUIRED_FIELDS
    ]
    rules = [
        _message(F.col("price") < 0, F.concat(F.lit("Invalid price: "), F.col("price").cast("string"))),
        _message(F.col("quantity") < 1, F.concat(F.lit("Invalid quantity: "), F.col("quantity").cast("string"))),
        _message(
            F.col("timestamp").isNotNull() & S.iso_timestamp(F.col("timestamp")).isNull(),
            F.concat(F.lit("Invalid timestamp format: "), F.col("timestamp")),
        ),
    ]
    return F.array_compact(F.array(*missing, *rules))


def contract_violations() -> Column:
    """The producer contract: the record rules plus the channel list and the metadata size."""
    channel = F.col("metadata")["channel"]
    return F.concat(violations(), F.array_compact(F.array(
        _message(channel.isNotNull() & ~channel.isin(*CHANNELS), F.concat(F.lit("Unknown channel: "), channel)),
        _message(F.octet_length(F.to_json("metadata")) > MAX_METADATA_BYTES, F.lit("Metadata too large")),
    )))


def with_validity(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", violations()).withColumn("is_valid", F.size("errors") == 0)


def is_complete() -> Column:
    """Streaming rule: nothing missing, price and quantity in range, and the time parses."""
    present = [F.col(f).isNotNull() for f in REQUIRED_FIELDS]
    rule = (F.col("price") >= 0) & (F.col("quantity") >= 1) & S.iso_timestamp(F.col("timestamp")).isNotNull()
    for p in present:
        rule = rule & p
    return rule


def drop_malformed(df: DataFrame) -> DataFrame:
    return df.filter(is_complete())


def is_loadable() -> Column:
    """Batch rule: id, parsed time, price and quantity. NULL counts as invalid."""
    return F.coalesce(
        F.col("id").isNotNull() & F.col("event_timestamp").isNotNull() & (F.col("price") >= 0) & (F.col("quantity") >= 1),
        F.lit(False),
    )


def with_time(df: DataFrame) -> DataFrame:
    """The typed time of wire records."""
    return df.withColumn("event_timestamp", S.iso_timestamp(F.col("timestamp")))


def normalize(df: DataFrame, trim: bool = False, timed: bool = False) -> DataFrame:
    """Typed time, day, hour, prefixed ids, place, total, metadata fields and processing stamps, in one projection.

    ``metadata`` may be a map or JSON text; ``location`` may be text or a JSON object. ``timed`` records hold their typed time already.
    """
    text = (lambda c: F.trim(F.col(c))) if trim else F.col
    is_map = isinstance(df.schema["metadata"].dataType, T.MapType)
    metadata = F.col("metadata") if is_map else F.from_json("metadata", "map<string,string>")
    parsed = (df if timed else with_time(df)).withColumns({"_place": S.location_struct(text("location")), "_meta": metadata})
    place, meta = F.col("_place"), F.col("_meta")
    return parsed.withColumns({
        "id": text("id"),
        "dt": S.partition_day(F.col("event_timestamp")),
        "event_hour": F.hour("event_timestamp"),
        "user_id": S.with_prefix(text("user_id"), "usr_"),
        "product_id": S.with_prefix(text("product_id"), "prod_"),
        "location": text("location"),
        "city": place["city"], "country": place["country"], "lat": place["lat"], "lon": place["lon"],
        "total_amount": S.line_total(F.col("price"), F.col("quantity")),
        "channel": meta["channel"],
        "device_type": F.coalesce(meta["device_type"], meta["device"]),
        "session_id": meta["session_id"],
        "processed_at": F.current_timestamp(),
        "processing_date": F.current_date(),
    }).drop("_place", "_meta")


def canonical_event() -> Column:
    """The nested output document; blank fields fall back to the metadata map."""
    pick = lambda c: F.coalesce(S.nonblank(F.col(c)), F.col("metadata")[c])
    return F.struct(
        F.col("id").alias("event_id"),
        F.lit("transaction").alias("event_type"),
        F.col("timestamp").alias("event_time"),
        F.struct(F.col("user_id").alias("id"), pick("session_id").alias("session_id")).alias("user"),
        F.struct(F.col("product_id").alias("id")).alias("product"),
        F.struct(F.col("price"), F.col("quantity"), F.col("total_amount").alias("total")).alias("transaction"),
        F.struct(F.col("location").alias("raw"), "city", "country", "region").alias("location"),
        pick("channel").alias("channel"),
        pick("device_type").alias("device_type"),
        F.col("dt").alias("partition_date"),
    )


def canonical_messages(df: DataFrame) -> DataFrame:
    """``key, value`` messages; NULL fields stay visible in the JSON."""
    return df.select(F.col("user_id").alias("key"), F.to_json(canonical_event(), {"ignoreNullFields": "false"}).alias("value"))


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """Any table as keyed JSON messages."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def adapt_columns(df: DataFrame) -> DataFrame:
    """Rename wire columns to feature columns, add the total where it is absent, prefix the ids."""
    names = {"id": "event_id", "timestamp": "event_timestamp"}
    out = df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})
    derived: dict[str, Column] = {}
    if "total_amount" not in out.columns and {"price", "quantity"} <= set(out.columns):
        derived["total_amount"] = F.col("price") * F.col("quantity")
    for column, prefix in (("user_id", "usr_"), ("product_id", "prod_")):
        if column in out.columns:
            derived[column] = S.with_prefix(F.col(column).cast("string"), prefix)
    if dict(out.dtypes).get("event_timestamp") == "string":
        derived["event_timestamp"] = S.iso_timestamp(F.col("event_timestamp"))
    return out.withColumns(derived)


def model_features(df: DataFrame, price: str | None = "price", total: str | None = "total", quantity: str | None = "quantity",
                   ts: str = "ts") -> DataFrame:
    """Robust numeric features of an event, with the defaults of the trainer."""
    column = lambda c: F.col(c) if c and c in df.columns else F.lit(None)
    amount = lambda c: F.nullif(column(c).cast("double"), F.lit(0.0))
    return df.withColumns({
        "f_price": F.coalesce(amount(price), amount(total), F.lit(0.0)),
        "f_quantity": F.coalesce(F.nullif(column(quantity).cast("int"), F.lit(0)), F.lit(1)),
        "f_hour": F.coalesce(F.hour(ts), F.lit(12)),
        "f_weekday": F.coalesce(S.monday_weekday(F.col(ts)), F.lit(0)),
    })


def dedupe_earliest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from .ordered import top_per_group

    return top_per_group(df, keys, order, 1)
