"""Models, forecasts and decisions (M), scoring exports (S17, S20), inference (X7)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import IndexToString
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boosting, churn, evaluate, events as E
from ..operators import forecast, ml, registry, tuning
from ..session import checkpointed, scratch_dir
from ..sources import files
from .catalog import query
from .evaluation import CONTRIB_SQL, contributions, predictions
from .tables import RUNS_SQL, VERSIONS_SQL, events, model_versions, runs, table, transactions
from .windows import DAILY_SQL, daily
from .joins import _BASELINE_SQL

EVENT_FEATURES = ("f_price", "f_quantity", "f_hour", "f_weekday", "user_bucket")
CHURN_FEATURES = ("transaction_count", "total_revenue", "avg_revenue", "std_revenue", "avg_price", "max_price", "min_price", "total_quantity",
                  "avg_quantity", "days_since_first", "days_since_last", "avg_days_between")


def event_features(spark, sf):
    rows = E.model_features(events(spark, sf), price="value")
    rows = rows.withColumn("user_bucket", S.hash_bucket(F.col("user_id").cast("string"), 1000).cast("double"))
    return ml.hash_split(rows, "event_id")


def event_rows(spark, sf):
    """Features of all events and the trained split, materialised once for iterative training."""
    rows = checkpointed(event_features(spark, sf).select("event_id", "event_type", "split", *EVENT_FEATURES))
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


@query("m1_label_encoding", """SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code, event_type AS decoded FROM events""")
def m1_label_encoding(spark, sf):
    e = events(spark, sf).select("event_id", "event_type")
    model = ml.label_encoder("event_type", "code").fit(e)
    back = IndexToString(inputCol="code", outputCol="decoded", labels=model.labels)
    return back.transform(model.transform(e)).select("event_id", "code", "decoded")


@query("m2_standardize", """WITH s AS (SELECT avg(value) FILTER (event_id % 5 <> 0) AS m, stddev_pop(value) FILTER (event_id % 5 <> 0) AS d FROM events)
SELECT event_id, round((value - m) / d, 6) AS z_value FROM events, s""")
def m2_standardize(spark, sf):
    return ml.standardize(events(spark, sf), ["value"], F.col("event_id") % 5 != 0).select("event_id", F.round("z_value", 6).alias("z_value"))


@query("m3_hash_split", """SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split,
  count(*) AS n, avg(quality) AS rate FROM labels GROUP BY 1""")
def m3_hash_split(spark, sf):
    return ml.hash_split(table(spark, sf, "labels"), "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.avg("quality").alias("rate"))


@query("m3_stratified_split", """WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT quality, 'test', n - CAST(floor(n * 0.8) AS BIGINT) FROM n""")
def m3_stratified_split(spark, sf):
    return ml.stratified_split(table(spark, sf, "labels"), "doc_id", "quality").groupBy("quality", "split").agg(F.count("*").alias("n"))


def _classifier_metrics(spark, sf, model_types, iterations=None):
    train, test = event_rows(spark, sf)
    parts = []
    for kind in model_types:
        model = ml.train_event_classifier(train, EVENT_FEATURES, "event_type", kind, iterations)
        scored = model.transform(test)
        parts.append(evaluate.weighted_metrics(scored).withColumn("model_type", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m4_event_classifier")
def m4_event_classifier(spark, sf):
    return _classifier_metrics(spark, sf, ("random_forest", "logistic_regression"))


@query("m4_boosted_classifier")
def m4_boosted_classifier(spark, sf):
    """One boosted model per class, a hundred rounds each, fitted side by side."""
    train, test = event_rows(spark, sf)
    scored = boosting.one_vs_rest(train, test, "event_id", EVENT_FEATURES, "event_type", boosting.Params(rounds=ml.GBT_ITERATIONS))
    return evaluate.weighted_metrics(scored).withColumn("model_type", F.lit("gradient_boosting"))


def churn_rows(spark, sf):
    behaviour = churn.churn_labels(transactions(spark, sf), 180)
    return checkpointed(ml.hash_split(behaviour.select("user_id", *CHURN_FEATURES, "churned"), "user_id"))


@query("m5_churn_search")
def m5_churn_search(spark, sf):
    """Four regularisations by five folds, ranked by area under ROC."""
    search = ml.search_churn_model(churn_rows(spark, sf).filter("split = 'train'"), CHURN_FEATURES, "churned")
    rows = [(i, float(auc)) for i, auc in enumerate(search.avgMetrics)]
    return spark.createDataFrame(rows, "trial int, auc double").orderBy(F.desc("auc"), "trial")


@query("m5_boosted_search")
def m5_boosted_search(spark, sf):
    """Twenty random draws of boosted trees by five folds, ranked by area under ROC."""
    train = churn_rows(spark, sf).filter("split = 'train'")
    return boosting.cross_validate(train, "user_id", CHURN_FEATURES, "churned", boosting.draws()).orderBy(F.desc("auc"), "trial")


@query("m6_batch_scoring")
def m6_batch_scoring(spark, sf):
    train, test = event_rows(spark, sf)
    model = ml.train_event_classifier(train, EVENT_FEATURES, "event_type", "logistic_regression")
    return ml.score(model, test).select("event_id", "predicted", F.round("confidence", 6).alias("confidence"), F.size("probabilities").alias("classes"))


_TREND_SQL = f"""{DAILY_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS back FROM daily), train AS (SELECT * FROM ranked WHERE back > 7),
o AS (SELECT series, min(ds) AS origin FROM train GROUP BY 1), timed AS (SELECT train.*, CAST(ds - origin AS DOUBLE) AS t, origin FROM train JOIN o USING (series)),
fit AS (SELECT series, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM timed GROUP BY 1),
trended AS (SELECT timed.*, intercept + slope * t AS trend, isodow(ds) - 1 AS wd FROM timed JOIN fit USING (series)),
weekly AS (SELECT series, wd, avg(y / trend) AS idx FROM trended GROUP BY 1, 2),
spread AS (SELECT series, stddev_samp(y - trend * idx) AS sigma FROM trended JOIN weekly USING (series, wd) GROUP BY 1)"""


def trend_model(spark, sf):
    split = forecast.time_split(daily(spark, sf), ["series"])
    return forecast.fit_trend(split.filter("split = 'train'"), ["series"])


@query("m7_trend_forecast", f"""WITH {_TREND_SQL}, l AS (SELECT series, max(ds) AS last_ds FROM train GROUP BY 1),
days AS (SELECT series, CAST(unnest(generate_series(last_ds + 1, last_ds + 7, INTERVAL 1 DAY)) AS DATE) AS ds FROM l)
SELECT days.series, days.ds, round((intercept + slope * (ds - origin)) * idx, 2) AS forecast, round((intercept + slope * (ds - origin)) * idx - 1.28 * sigma, 2) AS lower_bound
FROM days JOIN o USING (series) JOIN fit USING (series) JOIN spread USING (series) JOIN weekly ON weekly.series = days.series AND weekly.wd = isodow(days.ds) - 1""")
def m7_trend_forecast(spark, sf):
    out = forecast.forecast_range(trend_model(spark, sf), ["series"], F.date_add("last_ds", 1), F.date_add("last_ds", 7))
    return out.select("series", "ds", F.round("forecast", 2).alias("forecast"), F.round("lower_bound", 2).alias("lower_bound"))


def _values(xs):
    return ", ".join(f"({x!r}::DOUBLE)" for x in xs)


# The recursion over all grid points, a row per series and point; the least error wins, then the smaller parameters.
_SMOOTHING_SQL = f"""WITH RECURSIVE {DAILY_SQL}, n AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS t FROM daily),
grid AS (SELECT * FROM (VALUES {_values(forecast.ALPHAS)}) a(a), (VALUES {_values(forecast.BETAS)}) b(b), (VALUES {_values(forecast.DAMPINGS)}) p(p)),
walk AS (SELECT f.series, a, b, p, CAST(2 AS BIGINT) AS t, CAST(0 AS DOUBLE) + (s.y - (f.y + p * (s.y - f.y))) * (s.y - (f.y + p * (s.y - f.y))) AS err,
    f.y + p * (s.y - f.y) + a * (s.y - (f.y + p * (s.y - f.y))) AS level, p * (s.y - f.y) + a * b * (s.y - (f.y + p * (s.y - f.y))) AS slope
  FROM n f JOIN n s ON f.series = s.series AND f.t = 1 AND s.t = 2, grid
  UNION ALL SELECT w.series, a, b, p, n.t, err + (y - (level + p * slope)) * (y - (level + p * slope)), level + p * slope + a * (y - (level + p * slope)),
    p * slope + a * b * (y - (level + p * slope)) FROM walk w JOIN n ON n.series = w.series AND n.t = w.t + 1),
l AS (SELECT series, max(t) AS t, max(ds) AS last_ds FROM n GROUP BY 1),
best AS (SELECT w.*, last_ds FROM walk w JOIN l ON w.series = l.series AND w.t = l.t QUALIFY row_number() OVER (PARTITION BY w.series ORDER BY err, a, b, p) = 1)
SELECT series, CAST(last_ds + CAST(h AS INTEGER) AS DATE) AS ds, round(level + slope * p * (1 - p ** h) / (1 - p), 4) AS forecast FROM best, range(1, 8) r(h)"""


@query("m8_smoothing_forecast", _SMOOTHING_SQL)
def m8_smoothing_forecast(spark, sf):
    return forecast.fit_smoothing(daily(spark, sf), ["series"]).withColumn("forecast", F.round("forecast", 4))


@query("m8_mean_forecast", f"""WITH {DAILY_SQL} SELECT series, round(avg(y), 4) AS forecast FROM daily GROUP BY 1""")
def m8_mean_forecast(spark, sf):
    return forecast.mean_forecast(daily(spark, sf), ["series"]).withColumn("forecast", F.round("forecast", 4))


@query("m9_autoregression_forecast")
def m9_autoregression_forecast(spark, sf):
    split = forecast.time_split(daily(spark, sf), ["series"])
    return forecast.fit_autoregression(split.filter("split = 'train'").select("series", "ds", "y"), ["series"])


@query("m10_parameter_search")
def m10_parameter_search(spark, sf):
    """The leaderboard of every series: four families of models, halved on windows that double."""
    return tuning.leaderboard(daily(spark, sf), ["series"])


@query("m11_forecast_range", f"""WITH {_TREND_SQL}, days AS (SELECT series, CAST(unnest(generate_series(DATE '2001-09-01', DATE '2001-09-30', INTERVAL 1 DAY)) AS DATE) AS ds FROM o)
SELECT days.series, days.ds, round((intercept + slope * (ds - origin)) * idx, 2) AS forecast FROM days JOIN o USING (series) JOIN fit USING (series)
JOIN weekly ON weekly.series = days.series AND weekly.wd = isodow(days.ds) - 1""")
def m11_forecast_range(spark, sf):
    day = lambda d: F.lit(d).cast("date")
    out = forecast.forecast_range(trend_model(spark, sf), ["series"], day("2001-09-01"), day("2001-09-30"))
    return out.select("series", "ds", F.round("forecast", 2).alias("forecast"))


@query("m12_permutation_importance")
def m12_permutation_importance(spark, sf):
    train, test = event_rows(spark, sf)
    model = ml.train_event_classifier(train, EVENT_FEATURES, "event_type", "random_forest")
    return ml.permutation_importance(model, test, "event_id", EVENT_FEATURES, ml.accuracy)


@query("m12_split_importance")
def m12_split_importance(spark, sf):
    train, _ = event_rows(spark, sf)
    forest = ml.train_event_classifier(train, EVENT_FEATURES, "event_type", "random_forest").stages[-1]
    rows = [(f, float(v)) for f, v in zip(EVENT_FEATURES, forest.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


@query("m13_stage_transitions", f"""WITH {_BASELINE_SQL}, c AS (
  SELECT run_id, runs.model_name, b_mape IS NULL OR coalesce((b_mape - mape) / nullif(b_mape, 0) * 100 >= 5, false) OR coalesce((b_mse - mse) / nullif(b_mse, 0) * 100 >= 10, false) AS promote
  FROM runs LEFT JOIN base USING (model_name) WHERE status = 'FINISHED'),
w AS (SELECT v.model_name, v.version FROM versions v JOIN c ON v.run_id = c.run_id AND v.model_name = c.model_name WHERE promote
  QUALIFY row_number() OVER (PARTITION BY v.model_name ORDER BY v.version DESC) = 1)
SELECT v.model_name, v.version, CASE WHEN w.version = v.version THEN 'Staging' WHEN w.version IS NOT NULL AND stage = 'Staging' THEN 'Archived' ELSE stage END AS stage
FROM versions v LEFT JOIN w ON v.model_name = w.model_name""")
def m13_stage_transitions(spark, sf):
    """The newest promoted version of each model moves to staging, what was there is archived."""
    versions, all_runs = model_versions(spark, sf), runs(spark, sf)
    decided = registry.promotion_decisions(all_runs.filter("status = 'FINISHED'"), registry.production_baseline(versions, all_runs))
    winners = versions.join(decided.filter("promote").select("run_id", "model_name"), ["run_id", "model_name"])
    newest = registry.best_by(winners, ["model_name"], "run_id", "version", largest=True)
    moves = newest.select("model_name", "version", F.lit("Staging").alias("to_stage"))
    return registry.transition(versions, moves).select("model_name", "version", "stage")


_LINE_SQL = "WITH m AS (SELECT regr_slope(value, hour(ts)) AS slope, regr_intercept(value, hour(ts)) AS start FROM events)"


def fitted_line(spark, sf):
    """Value of an event by its hour, fitted to all events: the rows and the model's column."""
    rows = events(spark, sf).withColumn("hour", F.hour("ts").cast("double"))
    return rows, F.round(ml.linear_scorer(*ml.fit_linear(rows.select("hour", "value"), ["hour"], "value"))(F.col("hour")), 6)


@query("x7_frame_inference", f"{_LINE_SQL} SELECT event_id, round(start + slope * hour(ts), 6) AS prediction FROM events, m")
def x7_frame_inference(spark, sf):
    rows, prediction = fitted_line(spark, sf)
    return rows.select("event_id", prediction.alias("prediction"))


@query("s17_prediction_export", f"{_LINE_SQL} SELECT event_id, value, round(start + slope * hour(ts), 6) AS prediction FROM events, m")
def s17_prediction_export(spark, sf):
    """The given columns with the fitted model's prediction appended, as CSV, read back."""
    path = scratch_dir(spark, "scored")
    rows, prediction = fitted_line(spark, sf)
    rows.select("event_id", "value", prediction.alias("prediction")).write.csv(path, header=True)
    return files.read_csv(spark, path, "event_id long, value double, prediction double")


@query("s20_importance_export", f"""WITH {CONTRIB_SQL}, i AS (SELECT feature, round(avg(abs(contribution)), 9) AS importance FROM contrib GROUP BY 1)
SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, (SELECT count(DISTINCT doc_id) FROM contrib) AS samples FROM i""")
def s20_importance_export(spark, sf):
    """One JSON document with the ranked mean contributions of all features and the rows behind them, read back."""
    path = scratch_dir(spark, "importance")
    found = contributions(spark, sf)
    # A row per feature.
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("importance", 9)).alias("minus"), "feature"))),
                         lambda f, i: F.struct(f["feature"].alias("feature"), (-f["minus"]).alias("importance"), (i + 1).alias("rank")))
    summary = evaluate.importance(found).agg(ranked.alias("features"))
    summary.withColumn("samples", found.agg(F.countDistinct("doc_id")).scalar()).write.json(path)
    stored = spark.read.schema("features array<struct<feature:string,importance:double,rank:int>>, samples long").json(path)
    return stored.select(F.inline("features"), "samples")


@query("s20_explanation_export", f"""WITH {CONTRIB_SQL} SELECT 'pred_' || doc_id AS prediction_id, any_value(prediction) AS predicted_class, count(*) AS features, round(sum(contribution), 9) AS total
FROM contrib JOIN p USING (doc_id) GROUP BY doc_id""")
def s20_explanation_export(spark, sf):
    """One JSON document per prediction with its contributions, read back."""
    path = scratch_dir(spark, "explanations")
    # A row has a fixed, small number of features.
    items = contributions(spark, sf).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("feature", "value", F.col("contribution").alias("shap")))).alias("shap_values"))
    docs = items.join(predictions(spark, sf), "doc_id").select(
        F.concat(F.lit("pred_"), "doc_id").alias("prediction_id"), F.col("prediction").alias("predicted_class"), "shap_values")
    docs.write.json(path)
    stored = spark.read.schema("prediction_id string, predicted_class int, shap_values array<struct<feature:string,value:double,shap:double>>").json(path)
    total = F.aggregate("shap_values", F.lit(0.0), lambda acc, x: acc + x["shap"])
    return stored.select("prediction_id", "predicted_class", F.size("shap_values").cast("long").alias("features"), F.round(total, 9).alias("total"))
