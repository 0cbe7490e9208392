"""Declarative rules over events, documents and orders."""

from catalog.registry import frame, query, table, with_views
from twinframe.operators import expectations as ex


def _result(name, view, metrics, tables=False):
    """SQL for one rule: row count, violations and verdict."""
    return (("" if tables else with_views(view)) +
            f"SELECT '{name}' AS type, count(*) AS row_count, CAST({metrics} AS BIGINT) AS violations, "
            f"CASE WHEN {metrics} = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM {view}")


def _check(spark, sf, view, rule):
    return ex.check_expectations(frame(spark, sf, view), [rule]).select("type", "row_count", "violations", "result")


@query("exp_not_null", _result(ex.NOT_NULL, "events_src", "count(*) - count(value)"))
def exp_not_null(spark, sf):
    return _check(spark, sf, "events_src", {"type": ex.NOT_NULL, "column": "value"})


@query("exp_unique", _result(ex.UNIQUE, "documents", "count(*) - count(DISTINCT text)", True))
def exp_unique(spark, sf):
    return _check(spark, sf, "documents", {"type": ex.UNIQUE, "column": "text"})


@query("exp_between", _result(ex.BETWEEN, "events_src", "count(*) FILTER (value < 5 OR value > 100)"))
def exp_between(spark, sf):
    return _check(spark, sf, "events_src", {"type": ex.BETWEEN, "column": "value", "min_value": 5, "max_value": 100})


@query("exp_regex", _result(ex.REGEX, "events_src", "count(*) FILTER (props IS NULL OR NOT regexp_matches(props, '^(?:\\{\"k\": [1-5])'))"))
def exp_regex(spark, sf):
    return _check(spark, sf, "events_src", {"type": ex.REGEX, "column": "props", "regex": r'\{"k": [1-5]'})


@query("exp_in_set", _result(ex.IN_SET, "events_src", "count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase'))"))
def exp_in_set(spark, sf):
    return _check(spark, sf, "events_src",
                  {"type": ex.IN_SET, "column": "event_type", "value_set": ["view", "click", "purchase", 7]})


@query("exp_column_exists", """
SELECT 'expect_column_to_exist' AS type, count(*) AS row_count, CAST(1 AS BIGINT) AS violations, 'FAIL' AS result FROM events""")
def exp_column_exists(spark, sf):
    return _check(spark, sf, "events", {"type": ex.EXISTS, "column": "session"})


@query("exp_row_count", """
SELECT 'expect_table_row_count_to_be_between' AS type, count(*) AS row_count,
  CAST(CASE WHEN count(*) < 12000 THEN 1 ELSE 0 END AS BIGINT) AS violations,
  CASE WHEN count(*) < 12000 THEN 'FAIL' ELSE 'PASS' END AS result FROM events""")
def exp_row_count(spark, sf):
    return _check(spark, sf, "events", {"type": ex.ROW_COUNT, "min_value": 12000})


@query("exp_of_type", """
SELECT 'expect_column_values_to_be_of_type' AS type, count(*) AS row_count, CAST(0 AS BIGINT) AS violations,
  'PASS' AS result FROM events""")
def exp_of_type(spark, sf):
    return _check(spark, sf, "events", {"type": ex.OF_TYPE, "column": "value", "type_name": "float"})


ALL_RULES = [
    {"type": ex.NOT_NULL, "column": "note"}, {"type": ex.UNIQUE, "column": "o_orderkey"},
    {"type": ex.BETWEEN, "column": "o_totalprice", "min_value": 2000, "max_value": None},
    {"type": ex.REGEX, "column": "acct_code", "regex": "0"},
    {"type": ex.IN_SET, "column": "o_orderstatus", "value_set": ["O", "F", "P"]},
    {"type": ex.BETWEEN, "column": "note", "min_value": 1}, {"type": ex.NOT_NULL, "column": "gone"},
    {"type": ex.ROW_COUNT, "min_value": 1}]


def _side_sql(side):
    rules = [
        (0, "count(*) - count(note)"), (1, "count(*) - count(DISTINCT o_orderkey)"),
        (2, "count(*) FILTER (o_totalprice < 2000)"), (3, "count(*) FILTER (NOT starts_with(acct_code, '0'))"),
        (4, "count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P'))")]
    view, name = f"orders_{side}", {"src": "source", "tgt": "target"}[side]
    out = [f"SELECT '{name}' AS side, {i} AS rule, CAST({m} AS BIGINT) AS violations, "
           f"CASE WHEN {m} = 0 THEN 'PASS' ELSE 'FAIL' END AS result FROM {view}" for i, m in rules]
    out += [f"SELECT '{name}', 5, NULL, 'ERROR'", f"SELECT '{name}', 6, NULL, 'FAIL'",
            f"SELECT '{name}', 7, CAST(0 AS BIGINT), 'PASS'"]
    return " UNION ALL ".join(out)


@query("exp_suite", with_views("orders_src", "orders_tgt") + _side_sql("src") + " UNION ALL " + _side_sql("tgt"))
def exp_suite(spark, sf):
    return ex.run_expectations(frame(spark, sf, "orders_src"), frame(spark, sf, "orders_tgt"), ALL_RULES).select(
        "side", "rule", "violations", "result")


@query("exp_violations", """
SELECT doc_id, text FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def exp_violations(spark, sf):
    return ex.violating_rows(table(spark, sf, "documents").select("doc_id", "text"), {"type": ex.UNIQUE, "column": "text"})
