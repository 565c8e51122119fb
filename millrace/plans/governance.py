"""Privacy, access and the function surface (G, X)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions import scalars as S
from ..operators import access, geo
from ..session import scratch_dir, stored
from .catalog import query
from .joins import _places, _PLACES_SQL
from .tables import TX_SQL, table, transactions


def _people(spark, sf):
    """Customers with an address, a social number and a phone derived from their key."""
    key = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey",
        F.when(F.col("c_custkey") % 10 == 0, F.lit("broken")).otherwise(F.concat(F.lit("user"), key, F.lit("@example.com"))).alias("email"),
        F.lpad(key, 9, "5").alias("ssn"), F.lpad(key, 10, "7").alias("phone"))


_PEOPLE_SQL = """people AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey,
  CASE WHEN c_custkey % 10 = 0 THEN 'broken' ELSE 'user' || c_custkey || '@example.com' END AS email, lpad(CAST(c_custkey AS VARCHAR), 9, '5') AS ssn,
  lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS phone FROM customer)"""
_EMAIL_SQL = "CASE WHEN contains(email, '@') THEN left(email, 1) || '***@' || split_part(email, '@', 2) ELSE '***@***.***' END"


@query("g1_mask_columns", f"""WITH {_PEOPLE_SQL} SELECT c_custkey, {_EMAIL_SQL} AS email, '***-**-' || right(ssn, 4) AS ssn, '***-***-' || right(phone, 4) AS phone,
  left(c_name, 1) || '***' AS name, '*** REDACTED ***' AS address, '***' AS other FROM people""")
def g1_mask_columns(spark, sf):
    mask = P.mask_value
    return _people(spark, sf).select(
        "c_custkey", mask(F.col("email"), "email").alias("email"), mask(F.col("ssn"), "ssn").alias("ssn"), mask(F.col("phone"), "phone").alias("phone"),
        mask(F.col("c_name"), "name").alias("name"), mask(F.col("c_mktsegment"), "address").alias("address"), mask(F.col("c_mktsegment"), "text").alias("other"))


@query("g1_redact_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{9,}', '[NUMBER]', 'g')) AS digest FROM documents""")
def g1_redact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(P.redact_text(F.col("text"))).alias("digest"))


def _pad(key: bytes, x: int) -> str:
    return bytes(b ^ x for b in key.ljust(64, b"\0")).hex()


# A key for the tables of the tests. Jobs name theirs in the session's configuration.
DEMO_KEY = b"demo-key-for-tests"


def _keys(spark, key: bytes):
    """The configured key table, else one that holds the demo key."""
    configured = spark.conf.get(P.KEY_PATH, None)
    if configured:
        return P.key_table(spark, configured)
    return stored(spark.createDataFrame([(bytearray(key),)], "key binary"), "demo-key")


@query("g2_keyed_hash", f"""SELECT c_custkey, sha256(unhex('{_pad(DEMO_KEY, 0x5C)}') || unhex(sha256(unhex('{_pad(DEMO_KEY, 0x36)}') || encode(c_name)))) AS token,
  md5(c_name || 'pepper') AS salted FROM customer""")
def g2_keyed_hash(spark, sf):
    pads = P.hmac_pads(_keys(spark, DEMO_KEY))
    return table(spark, sf, "customer").select(
        "c_custkey", P.hmac_sha256(F.col("c_name"), pads).alias("token"), P.salted_md5(F.col("c_name"), "pepper").alias("salted"))


@query("g3_pseudonymize", "SELECT c_custkey, c_name AS restored, true AS hidden FROM customer")
def g3_pseudonymize(spark, sf):
    key = _keys(spark, hashlib.md5(DEMO_KEY).hexdigest().encode())
    hidden = table(spark, sf, "customer").select("c_custkey", "c_name", P.pseudonymize(F.col("c_name"), key).alias("token"))
    return hidden.select("c_custkey", P.depseudonymize(F.col("token"), key).alias("restored"), (F.col("token") != F.col("c_name")).alias("hidden"))


@query("g4_role_views", f"""WITH {_PEOPLE_SQL} SELECT 'analyst' AS role, c_custkey, {_EMAIL_SQL} AS email, c_mktsegment FROM people
UNION ALL SELECT 'admin', c_custkey, email, c_mktsegment FROM people""")
def g4_role_views(spark, sf):
    people = _people(spark, sf)
    view = lambda role: access.role_view(people, role, {"email": "email"}, ["c_custkey", "email", "c_mktsegment"]).select(
        F.lit(role).alias("role"), "c_custkey", "email", "c_mktsegment")
    return view("analyst").unionByName(view("admin"))


@query("g5_redacted_export", f"""WITH {_PEOPLE_SQL} SELECT c_custkey, {_EMAIL_SQL} AS email_masked, '***-**-' || right(ssn, 4) AS ssn_masked, md5(email || 'salt123') AS email_hash, c_mktsegment
FROM people JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def g5_redacted_export(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _people(spark, sf).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", P.mask_email(F.col("email")).alias("email_masked"), P.mask_ssn(F.col("ssn")).alias("ssn_masked"),
        P.salted_md5(F.col("email"), "salt123").alias("email_hash"), "c_mktsegment")


@query("g6_access_audit", """SELECT 'loader' AS actor, 'customer' AS dataset, 'write' AS operation, count(*) AS row_count, 'c_custkey,c_name' AS columns FROM customer""")
def g6_access_audit(spark, sf):
    out, audit = scratch_dir(spark, "audited"), scratch_dir(spark, "audit")
    access.write_audited(table(spark, sf, "customer").select("c_custkey", "c_name"), out, audit, "loader", "customer")
    return spark.read.parquet(audit).withColumn("columns", F.array_join("columns", ","))


@query("x1_arrow_region", f"""WITH {_PLACES_SQL} SELECT c_custkey, coalesce(city_region, box_region) AS region FROM located""")
def x1_arrow_region(spark, sf):
    """The row function as a native expression; the tests hold it against row-at-a-time code."""
    return geo.enrich_region(_places(spark, sf)).select("c_custkey", "region")


@query("x2_sql_functions", f"""WITH {_PEOPLE_SQL} SELECT c_custkey, {_EMAIL_SQL} AS email_masked, '***-**-' || right(ssn, 4) AS ssn_masked, md5(email || 'salt123') AS email_hash FROM people""")
def x2_sql_functions(spark, sf):
    P.register_sql_functions(spark)
    _people(spark, sf).createOrReplaceTempView("people_source")
    return spark.sql("SELECT c_custkey, mask_email(email) AS email_masked, mask_ssn(ssn) AS ssn_masked, hash_pii(email, 'salt123') AS email_hash FROM people_source")


@query("x3_row_lambdas", f"""WITH {TX_SQL} SELECT event_id AS id, user_id, region, NULL AS probe FROM tx
UNION ALL SELECT CAST(event_id AS VARCHAR), 'usr_' || user_id, 'Unknown', props->>'k' FROM events""")
def x3_row_lambdas(spark, sf):
    """Prefixing, place and JSON access as expressions instead of row functions."""
    bought = transactions(spark, sf).select(F.col("event_id").alias("id"), "user_id", "location", F.lit(None).cast("string").alias("props"))
    seen = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.lit("").alias("location"), "props")
    return bought.unionByName(seen).select("id", S.with_prefix(F.col("user_id"), "usr_").alias("user_id"), S.region_of(F.col("location")).alias("region"),
                                           F.from_json("props", "map<string,string>")["k"].alias("probe"))


@query("x4_modal_aggregate", """WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS favourite FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def x4_modal_aggregate(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("favourite"))
