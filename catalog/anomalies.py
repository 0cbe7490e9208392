"""Outlier detection over line items and events. A forest's scores have no SQL form; what follows from given scores has."""

from catalog.registry import VIEWS, frame, query, table, with_views
from twinframe.operators import anomaly
from twinframe.operators.profile import null_and_empty_counts
from twinframe.shared import spread

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def lines(spark, sf):
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *LINE_COLUMNS))


def flagged_events(spark, sf):
    return anomaly.detect_anomalies(spread(frame(spark, sf, "events_src")), ["value", "user_id"])


@query("anom_prepare", with_views("events_src") + """
SELECT 'value' AS column, count(*) - count(value) AS null_count FROM events_src
UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM events_src""")
def anom_prepare(spark, sf):
    df = frame(spark, sf, "events_src")
    usable = anomaly.numeric_columns(df, ["value", "event_type", "user_id"])
    return null_and_empty_counts(df, usable).select("column", "null_count")


@query("anom_fit")
def anom_fit(spark, sf):
    return anomaly.fit_forest(lines(spark, sf), LINE_COLUMNS)


@query("anom_score")
def anom_score(spark, sf):
    df = lines(spark, sf)
    return anomaly.score_rows(df, LINE_COLUMNS, anomaly.fit_forest(df, LINE_COLUMNS))


@query("anom_threshold")
def anom_threshold(spark, sf):
    df = lines(spark, sf)
    scored = anomaly.score_rows(df, LINE_COLUMNS, anomaly.fit_forest(df, LINE_COLUMNS))
    return anomaly.score_threshold(scored, LINE_COLUMNS)


@query("anom_summary")
def anom_summary(spark, sf):
    return anomaly.anomaly_summary(flagged_events(spark, sf))


@query("anom_column_ranges")
def anom_column_ranges(spark, sf):
    return anomaly.anomaly_ranges(flagged_events(spark, sf), ["value", "user_id"])


@query("anom_top")
def anom_top(spark, sf):
    return anomaly.top_anomalies(flagged_events(spark, sf), 20, ["event_id"])


@query("topk_anomalies")
def topk_anomalies(spark, sf):
    df = lines(spark, sf)
    flagged = anomaly.detect_anomalies(df, LINE_COLUMNS, contamination=0.01)
    return anomaly.top_anomalies(flagged, 50, ["l_orderkey", "l_linenumber", "l_partkey"])


# Events with a score that SQL can give as well; ties, and rows with a missing value.
VIEWS["events_scored"] = """
SELECT event_id, value, user_id, CASE WHEN value IS NULL THEN 0.0
  ELSE CAST((event_id * 7919) % 4093 - 4093 AS DOUBLE) / 4096 END AS anomaly_score FROM {events_src}"""
GIVEN = ["value", "user_id"]
_CUT = with_views("events_scored") + """,
cut AS (SELECT quantile_cont(anomaly_score, 0.02) AS threshold FROM events_scored WHERE value IS NOT NULL AND user_id IS NOT NULL),
marked AS (SELECT *, value IS NOT NULL AND user_id IS NOT NULL AND anomaly_score < threshold AS is_anomaly FROM events_scored, cut)
"""


@query("anom_threshold_given", _CUT + "SELECT threshold FROM cut")
def anom_threshold_given(spark, sf):
    return anomaly.score_threshold(frame(spark, sf, "events_scored"), GIVEN)


@query("anom_summary_given", _CUT + """
SELECT count(*) FILTER (is_anomaly) AS anomalies, count(*) AS total_rows, count(*) FILTER (is_anomaly) / count(*) * 100 AS rate,
  CASE WHEN count(*) FILTER (is_anomaly) = 0 THEN 'PASS' ELSE 'WARN' END AS result FROM marked""")
def anom_summary_given(spark, sf):
    return anomaly.anomaly_summary(anomaly.flag_anomalies(frame(spark, sf, "events_scored"), GIVEN))


@query("anom_column_ranges_given", _CUT + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", min(CAST({c} AS DOUBLE)) FILTER (is_anomaly) AS anomaly_min, max(CAST({c} AS DOUBLE)) FILTER (is_anomaly) AS anomaly_max,
  min(CAST({c} AS DOUBLE)) FILTER (NOT is_anomaly) AS normal_min, max(CAST({c} AS DOUBLE)) FILTER (NOT is_anomaly) AS normal_max
FROM marked""" for c in GIVEN))
def anom_column_ranges_given(spark, sf):
    return anomaly.anomaly_ranges(anomaly.flag_anomalies(frame(spark, sf, "events_scored"), GIVEN), GIVEN)


@query("anom_top_given", _CUT + """
SELECT event_id, value, user_id, anomaly_score, is_anomaly FROM marked WHERE is_anomaly ORDER BY anomaly_score, event_id LIMIT 50""")
def anom_top_given(spark, sf):
    return anomaly.top_anomalies(anomaly.flag_anomalies(frame(spark, sf, "events_scored"), GIVEN), 50, ["event_id"])
