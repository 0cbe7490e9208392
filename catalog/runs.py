"""Whole validation runs."""

from pyspark.sql import functions as F

from catalog.joins import ORDER_DIFFS, SORTED
from catalog.registry import LINE_COLUMNS, LINE_KEYS, frame, query, table, with_views
from catalog.run_sql import RunSql
from twinframe.plans.suite import run_suite, summary_frame
from twinframe.plans.validation import Options, validate


@query("run_validation")
def run_validation(spark, sf):
    options = Options(
        name="orders", regression=True,
        expectations=[{"type": "expect_column_values_to_not_be_null", "column": "note"},
                      {"type": "expect_column_values_to_be_unique", "column": "o_orderkey"}],
        anomaly={"columns": ["o_totalprice"], "run_on": "target"})
    return validate(frame(spark, sf, "orders_src"), frame(spark, sf, "orders_tgt"), "o_orderkey", options).results


def _run_sql():
    counts = lambda agg, c: f"(SELECT {agg.format(c=c)} FROM orders_src) AS s, (SELECT {agg.format(c=c)} FROM cut) AS t"
    text = lambda x: f"CAST({x} AS VARCHAR)"
    parts = [
        f"""SELECT 'record_count_check' AS validation, '' AS "column", CASE WHEN s = t THEN 'PASS' ELSE 'FAIL' END AS result,
        concat('Source: ', s, ' rows, Target: ', t, ' rows (cut to matching keys)') AS detail,
        {text('s')} AS source_value, {text('t')} AS target_value FROM (SELECT {counts('count(*)', '')}) AS n""",
        f"""SELECT 'primary_key_match', '', CASE WHEN sk = common THEN 'PASS' ELSE 'FAIL' END,
        concat('Common: ', common, ', Source-only: ', sk - common, ', Target-only: 0'), {text('sk')}, {text('common')} FROM m""",
        f"""SELECT 'symmetric_difference_check', '', CASE WHEN sk = common THEN 'PASS' ELSE 'FAIL' END,
        concat('Symmetric difference: ', sk - common, ' records (Source-only: ', sk - common, ', Target-only: 0)'),
        {text('sk - common')}, '0' FROM m"""]
    for c, test in ORDER_DIFFS.items():
        parts.append(f"""SELECT 'data_validation', '{c}', 'FAIL', concat(count(*), ' mismatches in column {c}'), '', ''
        FROM orders_src1 s JOIN orders_tgt1 t USING (o_orderkey) WHERE {test} HAVING count(*) > 0""")
        parts.append(f"""SELECT 'null_check', '{c}', CASE WHEN s = t THEN 'PASS' ELSE 'FAIL' END,
        concat('Source: ', s, ' nulls, Target: ', t, ' nulls'), {text('s')}, {text('t')}
        FROM (SELECT {counts('count(*) - count({c})', c)}) AS n WHERE s > 0 OR t > 0""")
        parts.append(f"""SELECT 'distinct_value_check', '{c}', 'FAIL', 'Distinct value count differs', {text('s')}, {text('t')}
        FROM (SELECT {counts('count(DISTINCT {c})', c)}) AS n WHERE s <> t""")
    return with_views("orders_src1", "orders_tgt1") + """
, cut AS (SELECT * FROM orders_tgt WHERE o_orderkey IN (SELECT o_orderkey FROM orders_src)),
m AS (SELECT (SELECT count(*) FROM orders_src1) AS sk,
  (SELECT count(*) FROM orders_src1 JOIN orders_tgt1 USING (o_orderkey)) AS common)
""" + " UNION ALL ".join(parts)


@query("run_validation_checks", _run_sql())
def run_validation_checks(spark, sf):
    """The summary rows of a run with all checks."""
    shown = ["record_count_check", "primary_key_match", "symmetric_difference_check", "data_validation", "null_check",
             "distinct_value_check"]
    out = validate(frame(spark, sf, "orders_src"), frame(spark, sf, "orders_tgt"), "o_orderkey", Options(regression=True))
    return out.results.where(F.col("validation").isin(shown) & (F.col("pk") == "")).drop("pk")


ORDER_TYPES = dict(o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string", o_totalprice="double",
                   o_orderdate="timestamp_ntz", o_orderpriority="string", acct_code="string", note="string")
LINE_TYPES = dict(zip(LINE_COLUMNS, ["bigint", "int", "bigint", "bigint", "int", "decimal(18,2)", "string", "string"]))
LINE_TESTS = {c: f"s.{c} <> t.{c}" for c in SORTED if c not in LINE_KEYS} | {"l_linestatus": "trim(s.l_linestatus) <> trim(t.l_linestatus)"}
ORDER_RULES = [("expect_column_values_to_not_be_null", "note"), ("expect_column_values_to_be_unique", "o_orderkey")]


def _rule_options(rules):
    return [{"type": kind, "column": column} for kind, column in rules]


@query("run_validation_complete", RunSql("SELECT * FROM orders_src", "SELECT * FROM orders_tgt", ["o_orderkey"], ORDER_TYPES, ORDER_DIFFS, True, True,
                                         rules=ORDER_RULES).sql(with_views("orders_src", "orders_tgt")))
def run_validation_complete(spark, sf):
    """Every row of a run with all checks that SQL can express, the larger side cut."""
    options = Options(regression=True, expectations=_rule_options(ORDER_RULES))
    return validate(frame(spark, sf, "orders_src"), frame(spark, sf, "orders_tgt"), "o_orderkey", options).results


@query("run_validation_pushdown", RunSql(
    "SELECT * FROM lines_src WHERE l_suppkey % 3 = 0", "SELECT * FROM lines_tgt WHERE (l_orderkey, l_linenumber) IN ("
    "SELECT (l_orderkey, l_linenumber) FROM lines_src WHERE l_suppkey % 3 = 0)", LINE_KEYS, LINE_TYPES, LINE_TESTS,
    True, True).sql(with_views("lines_src", "lines_tgt")))
def run_validation_pushdown(spark, sf):
    """A run that reads only the target rows of the source's composite keys."""
    source = frame(spark, sf, "lines_src").where("l_suppkey % 3 = 0")
    return validate(source, frame(spark, sf, "lines_tgt"), LINE_KEYS, Options(regression=True, filter_target=True)).results


@query("run_validation_composite", RunSql("SELECT * FROM lines_src", "SELECT * FROM lines_tgt", LINE_KEYS, LINE_TYPES, LINE_TESTS)
       .sql(with_views("lines_src", "lines_tgt")))
def run_validation_composite(spark, sf):
    return validate(frame(spark, sf, "lines_src"), frame(spark, sf, "lines_tgt"), LINE_KEYS, Options(name="lines")).results


_CUSTOMER = dict(c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string")
_POSTED = {c: ORDER_TYPES[c] for c in ("o_orderkey", "o_custkey", "o_orderstatus")}


@query("run_suite", " UNION ALL ".join([
    RunSql("SELECT * FROM customer", "SELECT * FROM customer", ["c_custkey"], _CUSTOMER,
           {c: f"s.{c} IS DISTINCT FROM t.{c}" for c in _CUSTOMER if c != "c_custkey"}).summary("customers"),
    RunSql("SELECT * FROM orders", "SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus FROM orders", ["o_orderkey"], _POSTED,
           {c: f"s.{c} IS DISTINCT FROM t.{c}" for c in _POSTED if c != "o_orderkey"}, True,
           more=["o_orderdate", "o_orderpriority", "o_totalprice"]).summary("orders")]))
def suite(spark, sf):
    for name in ("orders", "customer"):
        table(spark, sf, name).createOrReplaceTempView(f"twin_{name}")
    posted = "SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus FROM twin_orders"
    config = {"validations": [
        {"name": "customers", "primary_keys": "c_custkey",
         "source": {"type": "file", "path": f"{sf}/customer.parquet"}, "target": {"type": "table", "table": "twin_customer"}},
        {"name": "orders", "primary_keys": ["o_orderkey"], "regression": True,
         "source": {"type": "file", "path": f"{sf}/orders.parquet"}, "target": {"type": "table", "query": posted}}]}
    return summary_frame(spark, run_suite(spark, config)[0])
