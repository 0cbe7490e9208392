"""Aggregates over a long history of check results."""

from pyspark.sql import functions as F

from catalog.registry import frame, query, with_views
from catalog.scans import SUMMARY
from twinframe.operators import summaries

HISTORY = with_views("history")


def history(spark, sf):
    return frame(spark, sf, "history")


def _n(status):
    return f"count(*) FILTER (result = '{status}')"


@query("agg_status", HISTORY + f"""
SELECT {_n('PASS')} AS pass_count, {_n('FAIL')} AS fail_count, {_n('SKIP')} AS skip_count, count(*) AS total_count,
  CASE WHEN {_n('FAIL')} = 0 THEN 'PASS' ELSE 'FAIL' END AS overall FROM history""")
def agg_status(spark, sf):
    return summaries.status_counts(history(spark, sf))


@query("agg_by_validation", HISTORY + f"""
SELECT validation, {_n('PASS')} AS passes, {_n('FAIL')} AS fails FROM history GROUP BY 1""")
def agg_by_validation(spark, sf):
    return summaries.counts_by_validation(history(spark, sf))


TOP = HISTORY + """
SELECT "column", count(*) AS fails FROM history WHERE result = 'FAIL' AND "column" <> '' GROUP BY 1
ORDER BY fails DESC, "column" LIMIT {n}"""


@query("agg_top_columns", TOP.format(n=20))
def agg_top_columns(spark, sf):
    return summaries.top_failing_columns(history(spark, sf))


@query("topk_failing_columns", TOP.format(n=5))
def topk_failing_columns(spark, sf):
    return summaries.top_failing_columns(history(spark, sf), 5)


@query("agg_failure_summary", HISTORY + """
, f AS (SELECT validation, count(*) AS fails, min((ordinal, "column", detail)) AS first FROM history WHERE result = 'FAIL' GROUP BY 1)
SELECT validation, fails, first[2] AS column,
  CASE WHEN length(first[3]) > 120 THEN concat(substring(first[3], 1, 120), '…') ELSE first[3] END AS first_detail FROM f""")
def agg_failure_summary(spark, sf):
    return summaries.failure_summary(history(spark, sf))


@query("agg_failure_patterns", HISTORY + """
SELECT trim(source_value, '''') AS source_value, trim(target_value, '''') AS target_value,
  count(*) AS occurrences FROM history WHERE result = 'FAIL' GROUP BY 1, 2""")
def agg_failure_patterns(spark, sf):
    return summaries.failure_patterns(history(spark, sf))


@query("agg_row_counts_lookup", HISTORY + """
SELECT validation_name, arg_min(source_value, (ordinal, source_value, target_value)) AS source_rows,
  arg_min(target_value, (ordinal, source_value, target_value)) AS target_rows
FROM history WHERE validation = 'record_count_check' GROUP BY 1""")
def agg_row_counts_lookup(spark, sf):
    return summaries.row_counts(history(spark, sf))


@query("agg_run_summary", HISTORY + f"""
, s AS ({SUMMARY})
SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) AS total FROM s""")
def agg_run_summary(spark, sf):
    return summaries.run_summary(summaries.suite_summary(history(spark, sf)))


@query("set_union_results", HISTORY + """
SELECT 'first' AS validation_name, validation, result, pk FROM history WHERE result <> 'SKIP'
UNION ALL SELECT 'second', validation, result, pk FROM history WHERE result = 'SKIP'""")
def set_union_results(spark, sf):
    rows = history(spark, sf).select("validation", "result", "pk")
    return summaries.consolidate([("first", rows.where(F.col("result") != "SKIP")), ("second", rows.where(F.col("result") == "SKIP"))])
