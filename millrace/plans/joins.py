"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts, churn, features, geo, offsets, registry, retrieval
from ..operators.asof import asof_join
from ..operators.ordered import modal_value
from .catalog import query
from .features_sql import AS_OF, USER_FEATURES_SQL, esum, r2
from .monitoring_sql import ALERTS_SQL
from .retrieval_sql import CENTROIDS_SQL
from .tables import (OFFSETS_SQL, RUNS_SQL, TX_SQL, VERSIONS_SQL, committed_offsets, end_offsets, events, model_versions, runs, table,
                     transactions)

# City spellings by customer number: known, odd case, padded, unknown, blank and missing.
CITY_CASES = ("New York", "new york", " Tokyo ", "LONDON", "Winston-Salem", "", None, "Sydney", "são paulo", "Dubai", "paris ", "Lyon", "mumbai")


def _places(spark, sf):
    key = F.col("c_custkey")
    cities = F.array(*[F.lit(c) for c in CITY_CASES])
    return table(spark, sf, "customer").select(
        "c_custkey", cities[(key % len(CITY_CASES)).cast("int")].alias("city"),
        F.when(key % 11 != 0, (key * 37 % 181 - 90).cast("double")).alias("lat"), (key * 101 % 361 - 180).cast("double").alias("lon"))


_CITY_LIST = ", ".join("NULL" if c is None else f"'{c}'" for c in CITY_CASES)
_BOX_CASE = "\n    ".join(
    f"WHEN lat BETWEEN {b.min_lat} AND {b.max_lat} AND lon BETWEEN {b.min_lon} AND {b.max_lon} THEN '{b.code}'" for b in geo.BOXES)
_CITY_VALUES = ", ".join(f"('{c.lower()}', '{v[0]}')" for c, v in geo.CITIES.items())
_PLACES_SQL = f"""places AS (
  SELECT c_custkey, ([{_CITY_LIST}])[CAST(c_custkey % {len(CITY_CASES)} AS INTEGER) + 1] AS city,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 37 % 181 - 90 AS DOUBLE) END AS lat, CAST(c_custkey * 101 % 361 - 180 AS DOUBLE) AS lon FROM customer),
cities(name, code) AS (VALUES {_CITY_VALUES}),
located AS (
  SELECT places.*, code AS city_region, CASE WHEN lat IS NULL OR lon IS NULL THEN 'UNKNOWN'
    {_BOX_CASE} ELSE 'UNKNOWN' END AS box_region
  FROM places LEFT JOIN cities ON lower(trim(city)) = name)"""


@query("j1_region_by_city", f"""WITH {_PLACES_SQL} SELECT c_custkey, CASE WHEN city IS NULL THEN 'UNKNOWN' ELSE city_region END AS region FROM located""")
def j1_region_by_city(spark, sf):
    return _places(spark, sf).select("c_custkey", geo.region_by_city(F.col("city")).alias("region"))


@query("j2_region_by_box", f"""WITH {_PLACES_SQL} SELECT c_custkey, box_region AS region FROM located""")
def j2_region_by_box(spark, sf):
    return _places(spark, sf).select("c_custkey", geo.region_by_box(F.col("lat"), F.col("lon")).alias("region"))


@query("j2_region_by_box_table", """WITH boxes AS (
  SELECT n_nationkey AS ord, n_name AS code, -90.0 + 7 * (n_nationkey % 20) AS min_lat, -60.0 + 7 * (n_nationkey % 20) AS max_lat,
    -180.0 + 14 * n_nationkey AS min_lon, -120.0 + 14 * n_nationkey AS max_lon FROM nation),
points AS (SELECT c_custkey, CAST(c_custkey * 37 % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 101 % 361 - 180 AS DOUBLE) AS lon FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(code, ord) FROM boxes WHERE lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon), 'UNKNOWN') AS region
FROM points""")
def j2_region_by_box_table(spark, sf):
    k = F.col("n_nationkey")
    boxes = table(spark, sf, "nation").select(
        k.alias("ord"), F.col("n_name").alias("code"), (-90.0 + 7 * (k % 20)).alias("min_lat"), (-60.0 + 7 * (k % 20)).alias("max_lat"),
        (-180.0 + 14 * k).alias("min_lon"), (-120.0 + 14 * k).alias("max_lon"))
    c = F.col("c_custkey")
    points = table(spark, sf, "customer").select(
        "c_custkey", (c * 37 % 181 - 90).cast("double").alias("lat"), (c * 101 % 361 - 180).cast("double").alias("lon"))
    return geo.enrich_region_from_table(points, boxes, "lat", "lon").select("c_custkey", "region")


@query("j3_region_enrichment", f"""WITH {_PLACES_SQL} SELECT c_custkey, coalesce(city_region, box_region) AS region FROM located""")
def j3_region_enrichment(spark, sf):
    return geo.enrich_region(_places(spark, sf)).select("c_custkey", "region")


@query("j4_aggregate_with_mode", f"""WITH {TX_SQL}, agg AS (SELECT user_id, {r2(esum('total_amount'))} AS spend FROM tx GROUP BY 1),
fav AS (SELECT user_id, channel FROM (SELECT user_id, channel, count(*) AS n FROM tx GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, channel) = 1)
SELECT user_id, spend, channel FROM agg LEFT JOIN fav USING (user_id)""")
def j4_aggregate_with_mode(spark, sf):
    tx = transactions(spark, sf)
    spend = tx.groupBy("user_id").agg(S.round_half_up(S.stable_sum(F.col("total_amount"))).alias("spend"))
    return spend.join(modal_value(tx, ["user_id"], "channel").drop("n"), "user_id", "left")


@query("j5_active_users", """WITH c AS (SELECT max(o_orderdate) - INTERVAL 180 DAY AS cutoff FROM orders),
early AS (SELECT DISTINCT o_custkey FROM orders, c WHERE o_orderdate < cutoff), late AS (SELECT DISTINCT o_custkey FROM orders, c WHERE o_orderdate >= cutoff)
SELECT o_custkey, NOT EXISTS (SELECT 1 FROM late WHERE late.o_custkey = early.o_custkey) AS churned FROM early""")
def j5_active_users(spark, sf):
    return churn.activity_after_cutoff(table(spark, sf, "orders"), "o_custkey", "o_orderdate", 180)


@query("j6_point_in_time", """WITH f AS (SELECT user_id, ts AS fts, value AS fvalue, event_id AS fid FROM events WHERE event_type = 'purchase'),
r AS (SELECT * FROM events WHERE event_type <> 'purchase')
SELECT r.event_id, r.user_id, r.ts, CASE WHEN r.ts - fts <= INTERVAL 1 DAY THEN fvalue END AS feature_value,
  CASE WHEN r.ts - fts <= INTERVAL 1 DAY THEN fts END AS matched_ts
FROM r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.ts >= f.fts""")
def j6_point_in_time(spark, sf):
    e = events(spark, sf)
    features_ = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("fts"), F.col("value").alias("feature_value"))
    requests = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(requests, features_, ["user_id"], "ts", "fts", ["feature_value"], ttl_seconds=86400)


@query("j7_online_lookup", f"""WITH feats AS ({USER_FEATURES_SQL}), req AS (
  SELECT 'usr_' || c_custkey AS user_id FROM customer UNION ALL SELECT 'usr_new_' || n_nationkey FROM nation)
SELECT req.user_id, user_total_spend_30d, user_favorite_channel FROM req LEFT JOIN feats ON req.user_id = feats.user_id""")
def j7_online_lookup(spark, sf):
    feats = features.user_features(transactions(spark, sf), features.latest(table(spark, sf, "orders"), "o_orderdate"))
    known = table(spark, sf, "customer").select(F.concat(F.lit("usr_"), "c_custkey").alias("user_id"))
    unknown = table(spark, sf, "nation").select(F.concat(F.lit("usr_new_"), "n_nationkey").alias("user_id"))
    return features.online_lookup(known.unionByName(unknown), feats, "user_id").select(
        "user_id", "user_total_spend_30d", "user_favorite_channel")


@query("j8_query_scoring", f"""WITH {CENTROIDS_SQL}
SELECT vec_id, query_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) = 1""")
def j8_query_scoring(spark, sf):
    """Every index row against every query centroid; the best query is kept per row."""
    index = table(spark, sf, "embeddings")
    queries = retrieval.centroids(index, "label").withColumnRenamed("label", "query_id")
    return retrieval.nearest_query(index, queries).select("vec_id", "query_id", F.round("score", 6).alias("score"))


@query("j9_hit_metadata", f"""WITH {CENTROIDS_SQL}
SELECT query_id, vec_id, rank, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
JOIN documents ON vec_id = doc_id WHERE rank <= 10""")
def j9_hit_metadata(spark, sf):
    index = table(spark, sf, "embeddings")
    queries = retrieval.centroids(index, "label").withColumnRenamed("label", "query_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    return retrieval.search(index, queries, 10).join(docs, "vec_id").select("query_id", "vec_id", "rank", "lang", "n_chars")


_BASELINE_SQL = f"""{RUNS_SQL}, {VERSIONS_SQL}, prod AS (
  SELECT model_name, run_id FROM versions WHERE stage = 'Production' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY version DESC) = 1),
base AS (SELECT prod.model_name, mape AS b_mape, mse AS b_mse, auc AS b_auc FROM prod JOIN runs USING (run_id))"""


@query("j10_candidates_with_baseline", f"""WITH {_BASELINE_SQL}
SELECT run_id, model_name, unnest(['mape', 'mse', 'auc']) AS key, unnest([mape, mse, auc]) AS candidate, unnest([b_mape, b_mse, b_auc]) AS baseline
FROM runs LEFT JOIN base USING (model_name) WHERE status = 'FINISHED'""")
def j10_candidates_with_baseline(spark, sf):
    all_runs = runs(spark, sf)
    base = registry.production_baseline(model_versions(spark, sf), all_runs)
    return registry.compare_to_baseline(all_runs.filter("status = 'FINISHED'"), base).select("run_id", "model_name", "key", "candidate", "baseline")


LAG_SQL = f"""{OFFSETS_SQL}, lag AS (
  SELECT group_id, topic, partition, coalesce(committed, 0) AS current_offset, end_offset, greatest(0, end_offset - coalesce(committed, 0)) AS lag
  FROM committed JOIN ends USING (topic, partition))"""


@query("j11_partition_lag", f"""WITH {LAG_SQL} SELECT * FROM lag""")
def j11_partition_lag(spark, sf):
    return offsets.partition_lag(committed_offsets(spark, sf), end_offsets(spark, sf))


_SEVERE_SQL = "(SELECT * REPLACE (CASE WHEN value > 1.5 * threshold OR alertname = 'ServiceDown' THEN 'critical' ELSE 'warning' END AS severity) FROM states WHERE state = 'firing')"


def severe(spark, sf):
    """Firing grid points, severity by distance from the threshold, so one alert name carries both severities."""
    from .monitoring import alert_evaluations

    critical = (F.col("value") > 1.5 * F.col("threshold")) | (F.col("alertname") == "ServiceDown")
    return alert_evaluations(spark, sf).filter("state = 'firing'").withColumn("severity", F.when(critical, "critical").otherwise("warning"))


@query("j12_alert_inhibition", f"""WITH {ALERTS_SQL}, s AS {_SEVERE_SQL}
SELECT alertname, series, job, severity, ts FROM s WHERE NOT (severity = 'warning' AND EXISTS (
    SELECT 1 FROM s c WHERE c.severity = 'critical' AND c.alertname = s.alertname AND c.job = s.job AND c.ts = s.ts))
  AND NOT (alertname <> 'ServiceDown' AND EXISTS (SELECT 1 FROM s d WHERE d.alertname = 'ServiceDown' AND d.job = s.job AND d.ts = s.ts))""")
def j12_alert_inhibition(spark, sf):
    return alerts.inhibit(severe(spark, sf)).select("alertname", "series", "job", "severity", "ts")


@query("j13_predictions_with_segment", """
SELECT doc_id, quality AS label, lang AS segment, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)""")
def j13_predictions_with_segment(spark, sf):
    from .evaluation import predictions

    return predictions(spark, sf).select("doc_id", "label", "segment", "prediction")


@query("j14_version_details", f"""WITH {RUNS_SQL}, {VERSIONS_SQL}
SELECT model_name, version, stage, mape, priority FROM versions LEFT JOIN runs USING (run_id)""".replace("SELECT model_name, version", "SELECT versions.model_name, version"))
def j14_version_details(spark, sf):
    return registry.version_details(model_versions(spark, sf), runs(spark, sf)).select(
        "model_name", "version", "stage", F.col("metrics")["mape"].alias("mape"), F.col("params")["priority"].alias("priority"))


@query("j15_alert_routing", f"""WITH {ALERTS_SQL}
SELECT alertname, series, active_at, unnest(CASE
  WHEN severity = 'critical' AND team = 'ml-platform' THEN ['critical-alerts', 'pagerduty-ml']
  WHEN severity = 'critical' THEN ['critical-alerts', 'slack-data-platform']
  WHEN team = 'ml-platform' THEN ['slack-ml-platform'] ELSE ['slack-data-platform'] END) AS receiver FROM alerts""")
def j15_alert_routing(spark, sf):
    from .monitoring import alert_states

    return alerts.route(alert_states(spark, sf)).select("alertname", "series", "active_at", "receiver")
