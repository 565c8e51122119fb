"""Evaluation and fairness (A19-A26, W5, W9, T7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate
from .catalog import query
from .features_sql import esum
from .tables import events, table


def predictions(spark, sf):
    """Labelled documents scored by their length, the language as segment."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", F.col("lang").alias("segment"), "n_chars",
        F.col("n_chars").cast("double").alias("score"), F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("prediction"))


PRED_SQL = """p AS (SELECT doc_id, quality AS label, toxic, lang AS segment, n_chars, CAST(n_chars AS DOUBLE) AS score,
  CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id))"""


def _binary_sql(keys: str = "") -> str:
    lead, tail = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {lead}count(*) AS n_samples, CAST(sum(label) AS DOUBLE) / count(*) AS positive_rate,
  count(*) FILTER (label = prediction) / CAST(count(*) AS DOUBLE) AS accuracy,
  coalesce(count(*) FILTER (label = 1 AND prediction = 1) / CAST(nullif(count(*) FILTER (prediction = 1), 0) AS DOUBLE), 0) AS precision,
  coalesce(count(*) FILTER (label = 1 AND prediction = 1) / CAST(nullif(count(*) FILTER (label = 1), 0) AS DOUBLE), 0) AS recall,
  0.0 AS f1 FROM p {tail}"""


def _with_f1(sql: str) -> str:
    return f"SELECT * REPLACE (coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1) FROM ({sql})"


@query("a19_forecast_errors", """WITH f AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
SELECT user_id, round(coalesce(avg(abs((value - prev) / value)) FILTER (value <> 0) * 100, 'inf'::DOUBLE), 6) AS mape, round(avg((value - prev) * (value - prev)), 6) AS mse
FROM f WHERE prev IS NOT NULL GROUP BY 1""")
def a19_forecast_errors(spark, sf):
    from ..operators.ordered import previous_row

    lagged = previous_row(events(spark, sf), ["user_id"], ["ts"], ["value"], "ts", 86400).filter("prev_value IS NOT NULL")
    return evaluate.forecast_errors(lagged, "value", "prev_value", ["user_id"]).select(
        "user_id", F.round("mape", 6).alias("mape"), F.round("mse", 6).alias("mse"))


@query("a20_confusion_matrix", f"WITH {PRED_SQL} SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2")
def a20_confusion_matrix(spark, sf):
    return evaluate.confusion(predictions(spark, sf))


@query("a21_binary_metrics", f"WITH {PRED_SQL} {_with_f1(_binary_sql())}")
def a21_binary_metrics(spark, sf):
    return evaluate.binary_metrics(predictions(spark, sf))


@query("a21_weighted_metrics", f"""WITH {PRED_SQL}, c AS (SELECT label AS cls, count(*) AS support FROM p GROUP BY 1),
k AS (SELECT cls, support, (SELECT count(*) FROM p WHERE label = cls AND prediction = cls) AS tp, (SELECT count(*) FROM p WHERE prediction = cls) AS pred FROM c),
m AS (SELECT *, CASE WHEN pred > 0 THEN tp / CAST(pred AS DOUBLE) ELSE 0 END AS pr, tp / CAST(support AS DOUBLE) AS re FROM k)
SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, round(sum(pr * support) / sum(support), 9) AS precision_weighted, round(sum(re * support) / sum(support), 9) AS recall_weighted,
  round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 9) AS f1_weighted FROM m""")
def a21_weighted_metrics(spark, sf):
    out = evaluate.weighted_metrics(predictions(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in ("precision_weighted", "recall_weighted", "f1_weighted")})


_AUC = """(sum(CASE WHEN label = 1 THEN r ELSE 0 END) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)"""


def _auc_sql(keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - any_value(n1) * (any_value(n1) + 1) / 2.0) / nullif(CAST(any_value(n1) AS DOUBLE) * any_value(n0), 0), 9) AS auc
  FROM (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {lead}score) - 1) / 2.0 AS r,
    CAST(sum(label) OVER ({part}) AS BIGINT) AS n1, CAST(sum(1 - label) OVER ({part}) AS BIGINT) AS n0 FROM p) {('GROUP BY ' + keys) if keys else ''}"""


@query("a22_roc_auc", f"WITH {PRED_SQL} {_auc_sql()}")
def a22_roc_auc(spark, sf):
    return evaluate.roc_auc(predictions(spark, sf)).withColumn("auc", F.round("auc", 9))


@query("a23_segment_metrics", f"""WITH {PRED_SQL}, b AS ({_with_f1(_binary_sql('segment'))}), a AS ({_auc_sql('segment')})
SELECT b.*, auc FROM b LEFT JOIN a USING (segment) WHERE n_samples >= 5""")
def a23_segment_metrics(spark, sf):
    return evaluate.segment_metrics(predictions(spark, sf)).withColumn("auc", F.round("auc", 9))


@query("a24_demographic_parity", f"""WITH {PRED_SQL}, g AS (SELECT segment, count(*) AS n_samples, CAST(sum(prediction) AS DOUBLE) / count(*) AS selection_rate FROM p GROUP BY 1),
r AS (SELECT CASE WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) ELSE 1 END AS parity_ratio FROM g)
SELECT g.*, parity_ratio, parity_ratio >= 0.8 AS passed FROM g, r""")
def a24_demographic_parity(spark, sf):
    rates, verdict = evaluate.demographic_parity(predictions(spark, sf))
    v = verdict.select(F.struct("*")).scalar()
    return rates.select("*", v["parity_ratio"].alias("parity_ratio"), v["passed"].alias("passed"))


@query("a25_equalized_odds", f"""WITH {PRED_SQL}, g AS (SELECT segment, count(*) AS n_samples, avg(prediction) FILTER (label = 1) AS tpr, avg(prediction) FILTER (label = 0) AS fpr FROM p GROUP BY 1),
r AS (SELECT max(tpr) - min(tpr) AS tpr_gap, max(fpr) - min(fpr) AS fpr_gap FROM g)
SELECT g.*, tpr_gap, fpr_gap, tpr_gap <= 0.1 AND fpr_gap <= 0.1 AS passed FROM g, r""")
def a25_equalized_odds(spark, sf):
    rates, verdict = evaluate.equalized_odds(predictions(spark, sf))
    v = verdict.select(F.struct("*")).scalar()
    return rates.select("*", *[v[c].alias(c) for c in ("tpr_gap", "fpr_gap", "passed")])


FEATURES = ("n_chars", "toxic")


def contributions(spark, sf):
    """A linear score with the least-squares slope of each feature, so the contributions are exact and reproducible."""
    p = predictions(spark, sf)
    stats = p.agg(F.struct(*[F.regr_slope("label", f).alias(f"b_{f}") for f in FEATURES], *[F.avg(f).alias(f"m_{f}") for f in FEATURES])).scalar()
    pick = lambda k: {f: stats[f"{k}_{f}"] for f in FEATURES}
    return evaluate.linear_contributions(p, "doc_id", FEATURES, pick("b"), pick("m"))


CONTRIB_SQL = PRED_SQL + """, s AS (SELECT regr_slope(label, n_chars) AS b1, avg(n_chars) AS m1, regr_slope(label, toxic) AS b2, avg(toxic) AS m2 FROM p),
contrib AS (SELECT doc_id, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value, b1 * (n_chars - m1) AS contribution FROM p, s
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE), b2 * (toxic - m2) FROM p, s)"""


@query("a26_feature_importance", f"WITH {CONTRIB_SQL} SELECT feature, round(avg(abs(contribution)), 9) AS importance FROM contrib GROUP BY 1")
def a26_feature_importance(spark, sf):
    return evaluate.importance(contributions(spark, sf)).withColumn("importance", F.round("importance", 9))


@query("m12_linear_contributions", f"WITH {CONTRIB_SQL} SELECT doc_id, feature, value, round(contribution, 9) AS contribution FROM contrib")
def m12_linear_contributions(spark, sf):
    return contributions(spark, sf).withColumn("contribution", F.round("contribution", 9))


@query("w5_roc_points", f"""WITH {PRED_SQL}, s AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY 1)
SELECT score AS threshold, sum(pos) OVER w / CAST((SELECT sum(pos) FROM s) AS DOUBLE) AS tpr, sum(neg) OVER w / CAST((SELECT sum(neg) FROM s) AS DOUBLE) AS fpr
FROM s WINDOW w AS (ORDER BY score DESC)""")
def w5_roc_points(spark, sf):
    return evaluate.roc_points(predictions(spark, sf))


@query("w9_top_drivers", f"""WITH {CONTRIB_SQL} SELECT doc_id, coalesce(string_agg(feature, ',' ORDER BY abs(contribution) DESC, feature) FILTER (contribution > 0), '') AS positive_drivers,
  coalesce(string_agg(feature, ',' ORDER BY abs(contribution) DESC, feature) FILTER (contribution < 0), '') AS negative_drivers FROM contrib GROUP BY 1""")
def w9_top_drivers(spark, sf):
    return evaluate.top_drivers(contributions(spark, sf), "doc_id")


@query("t7_top_features", f"""WITH {CONTRIB_SQL} SELECT doc_id, feature, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, feature) AS rank FROM contrib
QUALIFY rank <= 1""")
def t7_top_features(spark, sf):
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions(spark, sf).withColumn("rank", F.row_number().over(order)).filter("rank <= 1").select("doc_id", "feature", "rank")
