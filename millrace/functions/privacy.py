"""Masking and keyed hashing as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_TYPES = ("email", "ssn", "phone", "name", "address", "text")
PRIVILEGED_ROLES = ("admin", "compliance", "data_protection")

#: Setting that names the folder of the one-row key table.
KEY_PATH = "millrace.privacy.key_path"

EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LONG_DIGITS_PATTERN = r"[0-9]{9,}"


def mask_email(value: Column) -> Column:
    """First character and domain; a placeholder when there is no address in it."""
    parts = F.split(value, "@")
    return F.when(value.isNull() | ~value.contains("@"), "***@***.***").otherwise(
        F.concat(F.substring(parts[0], 1, 1), F.lit("***@"), F.get(parts, F.lit(1)))
    )


def mask_ssn(value: Column) -> Column:
    return F.concat(F.lit("***-**-"), F.right(value, F.lit(4)))


def mask_phone(value: Column) -> Column:
    return F.concat(F.lit("***-***-"), F.right(value, F.lit(4)))


def mask_name(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.lit("***"))


def mask_value(value: Column, kind: str, role: str = "analyst") -> Column:
    """The masking rule of one data type, bypassed for privileged roles."""
    if role in PRIVILEGED_ROLES:
        return value
    rules = {"email": mask_email, "ssn": mask_ssn, "phone": mask_phone, "name": mask_name}
    if kind in rules:
        return rules[kind](value)
    return F.lit("*** REDACTED ***" if kind == "address" else "***")


def redact_text(text: Column) -> Column:
    """Free text: e-mail addresses and long digit runs are replaced."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL_PATTERN, "[EMAIL]"), LONG_DIGITS_PATTERN, "[NUMBER]")


def salted_md5(value: Column, salt: str) -> Column:
    return F.md5(F.concat(value, F.lit(salt)))


def key_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The one-row key table (key binary) in ``path`` or where the session's configuration says; never in code, never in a plan."""
    path = path or spark.conf.get(KEY_PATH, None)
    if not path:
        raise RuntimeError(f"set {KEY_PATH} before using keyed masking")
    return spark.read.schema("key binary").parquet(path)


def hmac_pads(keys: DataFrame) -> Column:
    """The inner and outer pad of a key as a scalar subquery: plans and event logs show only the read of the key table."""
    key = F.when(F.octet_length("key") > 64, F.unhex(F.sha2("key", 256))).otherwise(F.col("key"))
    byte = lambda i: F.when(i <= F.octet_length(key), F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("int")).otherwise(0)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(64)), byte)
    pad = lambda x: F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b.bitwiseXOR(F.lit(x)).cast("long")), 2, "0")), ""))
    return keys.select(F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer"))).scalar()


def hmac_sha256(value: Column, pads: Column) -> Column:
    """RFC 2104 over ``sha2``: H((K ^ opad) || H((K ^ ipad) || m)). ``pads`` comes from ``hmac_pads``."""
    inner_hash = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(pads["outer"], inner_hash), 256)


def pseudonymize(value: Column, keys: DataFrame) -> Column:
    return F.base64(F.aes_encrypt(value, keys.select("key").scalar(), F.lit("GCM")))


def depseudonymize(token: Column, keys: DataFrame) -> Column:
    return F.aes_decrypt(F.unbase64(token), keys.select("key").scalar(), F.lit("GCM")).cast("string")


SQL_FUNCTIONS = {
    "mask_email": "(e STRING) RETURNS STRING RETURN CASE WHEN e IS NULL OR NOT contains(e, '@') THEN '***@***.***' "
                  "ELSE concat(left(e, 1), '***@', split_part(e, '@', 2)) END",
    "mask_ssn": "(s STRING) RETURNS STRING RETURN concat('***-**-', right(s, 4))",
    "hash_pii": "(v STRING, salt STRING) RETURNS STRING RETURN md5(concat(v, salt))",
}


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines, so analysts can mask from SQL text."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
