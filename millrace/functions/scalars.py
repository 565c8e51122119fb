"""Column expressions shared by batch and streaming jobs. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


# Fixed value: a full calendar day, and optionally a time of day with a zone.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def iso_timestamp(text: Column) -> Column:
    """Full ISO text -> timestamp. Unparseable or partial text ("12:30", "2024", "2024-1-5") is NULL, whatever the day of the run."""
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(text))


def partition_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def with_prefix(value: Column, prefix: str) -> Column:
    return F.when(value.startswith(prefix), value).otherwise(F.concat(F.lit(prefix), value))


def location_part(location: Column, index: int) -> Column:
    """Comma part by position (0 or more); NULL when the part is absent. Cut without an array of all parts."""
    head = F.substring_index(location, ",", index + 1)
    if index == 0:
        return F.trim(head)
    # The part is there if what comes before it ends earlier than the text.
    before = F.substring_index(location, ",", index)
    return F.when(F.octet_length(before) < F.octet_length(location), F.trim(F.substring_index(head, ",", -1)))


def region_of(location: Column) -> Column:
    """Text after the last comma, ``Unknown`` without one."""
    return F.when(location.contains(","), F.trim(F.element_at(F.split(location, ","), -1))).otherwise("Unknown")


def line_total(price: Column, quantity: Column) -> Column:
    return F.round(price * quantity, 2)


def stable(result: Column) -> Column:
    """A result in twelve significant digits: what is left of sums whose last bits depend on the order of partitions."""
    return F.when(result.isNotNull(), F.format_string("%.11e", result).cast("double"))


def stable_sum(value: Column) -> Column:
    """Sum of doubles of any size; only the result is rounded."""
    return stable(F.sum(value.cast("double")))


def stable_avg(value: Column) -> Column:
    return F.try_divide(stable_sum(value), F.count(value))


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Plain IEEE rounding, the same arithmetic in every engine."""
    scale = float(10 ** digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def nonblank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def monday_weekday(ts: Column) -> Column:
    return F.weekday(ts)


def md5_number(value: Column) -> Column:
    """The first eight hex digits of the md5 of the value's text: the same number in every engine."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")


def hash_bucket(value: Column, buckets: int) -> Column:
    """Stable across processes, unlike a salted in-process hash."""
    return F.pmod(md5_number(value), F.lit(buckets))


def short_md5(value: Column, length: int = 12) -> Column:
    return F.substring(F.md5(value), 1, length)


def normalize_path(path: Column) -> Column:
    """Drop the query string, then replace UUIDs and numeric path parts."""
    bare = F.split(path, r"\?", 2)[0]
    return F.regexp_replace(F.regexp_replace(bare, UUID_PATTERN, "{id}"), r"/\d+", "/{id}")


def compact_count(value: Column) -> Column:
    """1234 -> '1,234'; a million and more -> '1.2M'."""
    return F.when(value < 1_000_000, F.format_number(value, 0)).otherwise(
        F.concat(F.format_number(value / 1_000_000, 1), F.lit("M"))
    )


LOCATION_OBJECT = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])


def location_struct(location: Column) -> Column:
    """Both wire shapes of a location: ``City, Country`` text or a JSON object with coordinates."""
    parsed = F.from_json(location, LOCATION_OBJECT)
    is_object = F.ltrim(location).startswith("{")
    return F.struct(
        F.when(is_object, parsed["city"]).otherwise(location_part(location, 0)).alias("city"),
        F.when(is_object, parsed["region"]).otherwise(location_part(location, 1)).alias("country"),
        F.when(is_object, parsed["latitude"]).alias("lat"),
        F.when(is_object, parsed["longitude"]).alias("lon"),
    )


def parse_transcript(text: Column) -> Column:
    """Thought, action, JSON input and final answer of one agent message."""
    is_final = text.contains("FINAL_ANSWER:")
    thought = F.trim(F.regexp_extract(text, r"(?s)Thought:\s*(.+?)(?=Action:|$)", 1))
    answer_parts = F.split(text, "FINAL_ANSWER:", 2)
    return F.struct(
        F.when(is_final, F.trim(F.regexp_replace(answer_parts[0], "Thought:", ""))).otherwise(thought).alias("thought"),
        F.when(~is_final, nonblank(F.regexp_extract(text, r"Action:\s*(\w+)", 1))).alias("action"),
        F.when(~is_final, F.from_json(
            nonblank(F.regexp_extract(text, r"(?s)Action Input:\s*(\{.*?\})", 1)), "map<string,string>"
        )).alias("action_input"),
        F.when(is_final, F.trim(F.get(answer_parts, F.lit(1)))).alias("final_answer"),
    )
