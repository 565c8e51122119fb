"""Sorts, limits, sampling, set operations and dedup (T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import churn, events as E
from ..operators import retrieval
from .catalog import query
from .retrieval_sql import CENTROIDS_SQL
from .scans import VIOLATIONS_SQL
from .tables import ENVELOPE_SQL, RAW_SQL, events, raw_transactions, table


@query("t1_time_sort", "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id")
def t1_time_sort(spark, sf):
    return events(spark, sf).select("event_id", "ts", "event_type").orderBy("ts", "event_id")


@query("t2_top_k_search", f"""WITH {CENTROIDS_SQL} SELECT query_id, vec_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 3""")
def t2_top_k_search(spark, sf):
    index = table(spark, sf, "embeddings")
    queries = retrieval.centroids(index, "label").withColumnRenamed("label", "query_id")
    return retrieval.search(index, queries, 3).select("query_id", "vec_id", "rank")


@query("t3_most_recent", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def t3_most_recent(spark, sf):
    return events(spark, sf).select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)


@query("t4_page", """SELECT event_id, ts, (SELECT count(*) FROM events) AS total, CAST(ceil((SELECT count(*) FROM events) / 50.0) AS BIGINT) AS pages
FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100""")
def t4_page(spark, sf):
    """Third page of 50. Deep pages use ``(ts, event_id) < last`` instead of an offset."""
    e = events(spark, sf)
    total = e.agg(F.count("*")).scalar()
    page = e.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50)
    return page.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / 50))


@query("t4_keyset_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def t4_keyset_page(spark, sf):
    """The page after a known last row (ts, event_id): a filter that the scan can use, and one top-n. Tied times lose no row."""
    e = events(spark, sf).select("event_id", "ts")
    newest = [F.desc("ts"), F.desc("event_id")]
    last = e.orderBy(*newest).limit(50).agg(F.min(F.struct("ts", "event_id")).alias("last"))
    return keyset_page(e, last.select("last.ts").scalar(), last.select("last.event_id").scalar(), 50)


def keyset_page(rows, ts, event_id, size):
    """The ``size`` newest rows after the row (ts, event_id)."""
    after = (F.col("ts") <= ts) & ((F.col("ts") < ts) | (F.col("event_id") < event_id))
    return rows.filter(after).orderBy(F.desc("ts"), F.desc("event_id")).limit(size)


@query("t5_invalid_sample", f"""WITH {RAW_SQL}, e AS (SELECT id, product_id, {VIOLATIONS_SQL}) AS errors FROM raw)
SELECT * FROM e WHERE errors <> '' ORDER BY id, product_id LIMIT 5""")
def t5_invalid_sample(spark, sf):
    """The first five invalid rows by id."""
    bad = E.with_validity(raw_transactions(spark, sf)).filter("NOT is_valid").orderBy("id", "product_id").limit(5)
    return bad.select("id", "product_id", F.regexp_replace(F.array_join("errors", "; "), r"(Invalid price): [-0-9.E]+", "$1").alias("errors"))


@query("t6_random_sample", f"""WITH {RAW_SQL} SELECT id, "timestamp", user_id, product_id, price, quantity, location FROM raw
ORDER BY md5(id || '/' || product_id || '/42'), id, product_id LIMIT 1000""")
def t6_random_sample(spark, sf):
    """Reproducible sample without replacement: the smallest seeded hashes."""
    seeded = raw_transactions(spark, sf).withColumn("_h", F.md5(F.concat_ws("/", "id", "product_id", F.lit("42"))))
    return seeded.orderBy("_h", "id", "product_id").limit(1000).drop("_h", "metadata")


@query("u1_user_overlap", """WITH c AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS cutoff FROM orders), u AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1),
n AS (SELECT count(*) FILTER (f < cutoff) AS train_users, count(*) FILTER (l >= cutoff) AS active_users, count(*) FILTER (f < cutoff AND l >= cutoff) AS "both" FROM u, c)
SELECT *, "both" / CAST(train_users AS DOUBLE) AS overlap_fraction FROM n""")
def u1_user_overlap(spark, sf):
    return churn.overlap(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 30)


@query("u2_union_variants", f"""WITH {ENVELOPE_SQL} SELECT id, price, kafka_offset, 'stream' AS variant FROM env
UNION ALL SELECT CAST(event_id AS VARCHAR), value, NULL, 'batch' FROM events""")
def u2_union_variants(spark, sf):
    """The batch table has no broker columns; they come out NULL."""
    from .tables import envelope

    stream = E.decode_envelope(envelope(spark, sf)).select("id", "price", "kafka_offset", F.lit("stream").alias("variant"))
    batch = events(spark, sf).select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("price"), F.lit("batch").alias("variant"))
    return stream.unionByName(batch, allowMissingColumns=True)


@query("u3_dedupe", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def u3_dedupe(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return E.dedupe_earliest(lines, ["l_orderkey", "l_linenumber"], [F.asc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")])
