"""Sinks under replay and restart, table maintenance, registry, alerts and forecasts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import access, alerts, churn, features, forecast, metrics, ml, registry
from millrace.operators import events as E
from millrace.plans.tables import raw_transactions, transactions
from millrace.session import scratch_root
from millrace.sources import lake, snapshot
from millrace.streaming import sinks

T0 = dt.datetime(2024, 1, 1)
RECORD = '{"id":"%s","timestamp":"2024-01-0%dT10:00:00Z","user_id":"u","product_id":"p","price":2.5,"quantity":2,"location":"London, UK","metadata":{}}'


def records(spark, ids):
    return spark.createDataFrame([("u", RECORD % (i, 1 + i % 3), "t", 0, i, T0) for i in ids], E.ENVELOPE_SCHEMA)


def test_replayed_batch_is_written_once(spark, tmp_path):
    """A batch that died between its two sinks is run again under the same id."""
    table, topic = str(tmp_path / "table"), str(tmp_path / "topic")
    batch = sinks.ingest(records(spark, range(9)))
    batch.select(*E.STREAM_COLUMNS, F.lit(0).alias("batch_id")).write.partitionBy("dt", "batch_id").parquet(table)
    sinks.write_batch(batch, 0, table, topic)
    sinks.write_batch(batch, 0, table, topic)
    assert spark.read.parquet(table).count() == 9
    assert sinks.read_messages(spark, topic).count() == 9


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    topic, table, mirror, checkpoint = (str(tmp_path / n) for n in ("t", "table", "mirror", "ck"))
    for ids in (range(5), range(5, 12)):
        sinks.publish(records(spark, ids), topic)
        sinks.run_dual_sink(sinks.ingest(sinks.read_topic(spark, topic)), table, mirror, checkpoint)
    assert sorted(int(r.id) for r in spark.read.parquet(table).select("id").collect()) == list(range(12))
    assert sinks.read_messages(spark, mirror).count() == 12


def test_stream_writes_few_files_a_day(spark, tmp_path):
    """The batch is shuffled by day though a stream runs without adaptive execution, which is left as it was."""
    topic, table, mirror, checkpoint = (str(tmp_path / n) for n in ("t", "table", "mirror", "ck"))
    sinks.publish(records(spark, [*range(60), *range(60)]), topic)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    sinks.run_dual_sink(sinks.ingest(sinks.read_topic(spark, topic), "10 minutes", ["id"]), table, mirror, checkpoint)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    assert sorted(int(r.id) for r in spark.read.parquet(table).select("id").collect()) == list(range(60))
    assert sinks.read_messages(spark, mirror).count() == 60
    assert len(list((tmp_path / "table").glob("dt=*/batch_id=0/*.parquet"))) == 3


def test_copies_go_before_records_are_normalised(spark):
    """Keys that normalising changes are compared as they are after it: ``u`` and ``usr_u`` are one user."""
    sent = records(spark, range(4)).unionByName(records(spark, [9]).withColumn("value", F.replace("value", F.lit('"u"'), F.lit('"usr_u"'))))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    by_id = plan(sinks.ingest(sent, "10 minutes", ["id"]))
    assert by_id.index("city") < by_id.index("DeduplicateWithinWatermark")  # nodes are listed from the last to the first
    by_user = plan(sinks.ingest(sent, "10 minutes", ["user_id"]))
    assert by_user.index("DeduplicateWithinWatermark") < by_user.index("city") or by_user.startswith("DeduplicateWithinWatermark")


def test_lines_are_shuffled_for_their_orders_only(spark):
    """Where no dimension can be broadcast, lines meet orders that know their customer and place; the rows follow the keys."""
    root = scratch_root(spark) + "/line-tables"
    day = "timestamp_ntz'2024-01-02 03:04:05.678'"
    tables = {
        "lineitem": "select * from values (1L, 7L, 1, 2.0D, 10.0D), (1L, 8L, 2, 3.0D, 5.0D), (2L, 7L, 1, 1.0D, 4.0D), (9L, 7L, 1, 1.0D, 4.0D) "
                    "as t(l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice)",
        "orders": f"select * from values (1L, 5L, {day}, 'URGENT'), (2L, 6L, {day}, null), (3L, 5L, {day}, 'LOW') "
                  "as t(o_orderkey, o_custkey, o_orderdate, o_orderpriority)",
        "customer": "select * from values (5L, 3, 'BUILDING'), (6L, 4, 'MACHINERY') as t(c_custkey, c_nationkey, c_mktsegment)",
        "nation": "select * from values (3, 'Peru', 1), (4, 'Oman', 2) as t(n_nationkey, n_name, n_regionkey)",
        "region": "select * from values (1, 'AMERICA') as t(r_regionkey, r_name)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tx = transactions(spark, root)
        plan = tx._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    line_side = plan[: plan.index("lineitem.parquet")]
    assert line_side.count("SortMergeJoin") == 1  # the plan lists the lines' side first, so one join stands above them
    rows = sorted((r.event_id, r.user_id, r.location, r.total_amount, r.channel) for r in tx.collect())
    assert rows == [("1-1", "usr_5", "Peru, AMERICA", 20.0, "URGENT"), ("1-2", "usr_5", "Peru, AMERICA", 15.0, "URGENT")]
    assert {r.timestamp for r in raw_transactions(spark, root).collect()} == {"2024-01-02T03:04:05Z"}


def test_overwrite_touches_one_partition(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in range(30)], "x int, dt string")
    lake.write_table(rows, path, files_per_partition=3)
    lake.write_table(spark.createDataFrame([(99, "2024-01-02")], "x int, dt string"), path, mode="overwrite")
    got = lake.read_table(spark, path)
    assert got.count() == 21 and [r.x for r in got.filter("dt = '2024-01-02'").collect()] == [99]
    lake.compact_files(spark, path)
    assert lake.read_table(spark, path).filter("dt = '2024-01-01'").count() == 10
    assert len(list((tmp_path / "lake" / "dt=2024-01-01").glob("*.parquet"))) == 1
    assert lake.retain(lake.read_table(spark, path), "2024-01-03", 1).select("dt").distinct().count() == 2


def test_merge_latest_keeps_newer_rows(spark, tmp_path):
    path = str(tmp_path / "online")
    snapshot.merge(spark, spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "k int, ts int, v string"), path, ["k"], "ts")
    snapshot.merge(spark, spark.createDataFrame([(1, 5, "old"), (2, 20, "new"), (3, 1, "c")], "k int, ts int, v string"), path, ["k"], "ts")
    assert {r.k: r.v for r in snapshot.read(spark, path, ["k"], "ts").collect()} == {1: "a", 2: "new", 3: "c"}


def runs_frame(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model_name string, metrics map<string,double>")


def decisions(spark, candidates, baseline):
    base = spark.createDataFrame(baseline, "model_name string, key string, baseline double")
    return {r.run_id: r for r in registry.promotion_decisions(runs_frame(spark, candidates), base).collect()}


def test_promotion_rules(spark):
    base = [("m", "mape", 20.0), ("m", "mse", 2000.0)]
    got = decisions(spark, [("better", "m", {"mape": 15.0, "mse": 1500.0}), ("same", "m", {"mape": 19.5, "mse": 1950.0}),
                            ("worse", "m", {"mape": 24.0}), ("nan", "m", {"mape": float("nan")}), ("first", "new", {"mape": 50.0}),
                            ("rmse", "m", {"rmse": 0.1})], base)
    assert got["better"].promote and got["better"].reason == (
        "mape improved by 25.00% (threshold: 5.0%); mse reduced by 25.00% (threshold: 10.0%)")
    assert not any(got[k].promote for k in ("same", "worse", "nan"))
    assert got["first"].promote and "first model" in got["first"].reason


def test_nan_baseline_does_not_promote(spark):
    assert not decisions(spark, [("r", "m", {"mape": 1.0})], [("m", "mape", float("nan"))])["r"].promote


def test_rollback_and_transition(spark):
    versions = spark.createDataFrame([("a", 1, "Archived"), ("a", 2, "Production"), ("b", 1, "Production"), ("c", 1, "None")],
                                     "model_name string, version int, stage string")
    got = {r.model_name: (r.target_version, r.reason) for r in registry.rollback_targets(versions).collect()}
    assert got == {"a": (1, "rollback"), "b": (None, "no previous version"), "c": (None, "no production version")}
    moves = spark.createDataFrame([("a", 1, "Production")], "model_name string, version int, to_stage string")
    after = {(r.model_name, r.version): r.stage for r in registry.transition(versions, moves).collect()}
    assert after[("a", 1)] == "Production" and after[("a", 2)] == "Archived" and after[("b", 1)] == "Production"


def test_alert_hold_and_gap(spark):
    values = [(0, 0.3), (1, 0.3), (2, 0.05), (3, 0.3), (6, 0.3)]
    frame = spark.createDataFrame([("model_drift_score", "s", "j", T0 + dt.timedelta(hours=h), v) for h, v in values],
                                  "metric string, series string, job string, ts timestamp_ntz, value double")
    got = [(r.ts.hour, r.active_at.hour, r.state) for r in
           alerts.evaluations(frame).filter("alertname = 'ModelDriftDetected'").orderBy("ts").collect()]
    assert got == [(0, 0, "pending"), (1, 0, "firing"), (3, 3, "pending"), (6, 6, "pending")]


def test_inhibition_and_routes(spark):
    rows = [("A", "j", "critical", "ml-platform"), ("A", "j", "warning", "ml-platform"), ("B", "j", "warning", "data-platform"),
            ("ServiceDown", "k", "critical", "ml-platform"), ("C", "k", "critical", "x"), ("XDriftY", "j", "warning", "x")]
    frame = spark.createDataFrame([(T0, *r) for r in rows], "ts timestamp_ntz, alertname string, job string, severity string, team string")
    kept = {(r.alertname, r.severity) for r in alerts.inhibit(frame).collect()}
    assert kept == {("A", "critical"), ("B", "warning"), ("ServiceDown", "critical"), ("XDriftY", "warning")}
    routed = {}
    for r in alerts.route(frame).collect():
        routed.setdefault((r.alertname, r.severity), set()).add(r.receiver)
    assert routed[("A", "critical")] == {"critical-alerts", "pagerduty-ml"} and routed[("XDriftY", "warning")] == {"slack-model-monitoring"}
    assert routed[("C", "critical")] == {"critical-alerts", "slack-ml-platform"}


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([(0.02,)] * 50 + [(99.0,)] * 50, "v double")
    assert metrics.histogram_quantile(df, "v", 0.25).first()[0] == pytest.approx(0.01 + 0.015 * 0.5)
    assert metrics.histogram_quantile(df, "v", 0.9).first()[0] == 10.0


def test_churn_of_returning_users(spark):
    rows = [("e1", T0, "stay", 5.0), ("e2", T0 + dt.timedelta(days=20), "stay", 5.0), ("e3", T0, "gone", 5.0), ("e4", T0 + dt.timedelta(days=1), "gone", 7.0)]
    tx = spark.createDataFrame(rows, "event_id string, event_timestamp timestamp_ntz, user_id string, total_amount double").withColumns(
        {"price": F.lit(1.0), "quantity": F.lit(1), "channel": F.lit("web")})
    got = {r.user_id: r for r in churn.churn_labels(tx).collect()}
    assert (got["stay"].churned, got["gone"].churned) == (0, 1)
    assert got["stay"].std_revenue == 0.0 and got["gone"].transaction_count == 2


def test_feature_invariants_and_fallback(spark):
    tx = spark.createDataFrame([("e", T0, "u", "p", 2.0, 3, 6.0, "X, Y", None)],
                               "event_id string, event_timestamp timestamp_ntz, user_id string, product_id string, price double, quantity int, "
                               "total_amount double, location string, channel string")
    as_of = F.expr("TIMESTAMP_NTZ '2024-06-01'")
    assert features.user_features(tx, as_of).count() == 0
    row = features.user_features(tx, as_of, fallback=True).first()
    assert row.user_favorite_channel == "unknown" and row.user_days_since_last_purchase == 152
    product = features.product_features(tx, as_of, fallback=True).first()
    assert product.product_min_price_30d <= product.product_max_price_30d and product.product_top_region == "Y"


def daily(spark, n, series="s"):
    return spark.createDataFrame([(series, (T0 + dt.timedelta(days=i)).date(), 100.0 + i) for i in range(n)], "series string, ds date, y double")


def test_forecasts_follow_a_line(spark):
    rows = daily(spark, 60)
    model = forecast.fit_trend(rows, ["series"])
    ahead = forecast.forecast_range(model, ["series"], F.date_add("last_ds", 1), F.date_add("last_ds", 3)).orderBy("ds").collect()
    assert [r.forecast for r in ahead] == pytest.approx([160.0, 161.0, 162.0], rel=0.02)
    assert all(r.lower_bound <= r.forecast <= r.upper_bound for r in ahead)
    smooth = forecast.fit_smoothing(rows, ["series"], 3).orderBy("ds").collect()
    assert [r.forecast for r in smooth] == pytest.approx([160.0, 161.0, 162.0], rel=0.02)
    auto = forecast.fit_autoregression(rows, ["series"], 3).orderBy("ds").collect()
    assert [r.forecast for r in auto] == pytest.approx([160.0, 161.0, 162.0], rel=0.05)


def test_short_series_fall_back_to_the_mean(spark):
    short = daily(spark, 2, "short").unionByName(daily(spark, 40, "long"))
    for out in (forecast.fit_smoothing(short, ["series"], 1), forecast.fit_autoregression(short, ["series"], 1)):
        assert out.filter("series = 'short'").first()["forecast"] == pytest.approx(100.5)


def test_search_prefers_the_lowest_error(spark):
    results, best = forecast.search_parameters(daily(spark, 40), ["series"])
    assert best.first()["mape"] == min(r.mape for r in results.collect())


def test_splits_are_stable_and_stratified(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    split = lambda d: {(r.id, r.split) for r in ml.hash_split(d, "id").select("id", "split").collect()}
    assert split(df) == split(df.repartition(7))
    counts = {(r.label, r.split): r["count"] for r in ml.stratified_split(df, "id", "label").groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}


def test_shuffled_column_is_a_permutation(spark):
    df = spark.range(500).withColumn("x", F.col("id").cast("double"))
    got = ml.shuffled_column(df, "id", "x", rows_per_bucket=90).collect()
    assert sorted(r.x for r in got) == [float(i) for i in range(500)] and sum(r.x != r.id for r in got) > 400


def test_unusual_access(spark):
    audit = spark.createDataFrame([("busy", ["t"], ["email"], T0)] * 101 + [("calm", ["t"], ["x"], T0)],
                                  "user_name string, accessed_tables array<string>, accessed_columns array<string>, timestamp timestamp_ntz")
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-01 00:30:00'")
    assert [r.user_name for r in access.unusual_access(audit, as_of).collect()] == ["busy"]
    assert access.pii_access(audit, as_of).count() == 101


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
