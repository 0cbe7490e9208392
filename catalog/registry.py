"""Registration of queries and the views they share.

A view is one SELECT that Spark and DuckDB both understand, with tables and
other views in braces. The pairs differ by rewritten values and keys; every
view covers its whole table.
"""

import re

QUERIES, SQL = {}, {}
VIEWS = {}


def query(name, sql=None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL if there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query '{name}' registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _names(text):
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def frame(spark, sf, name):
    """A table or view as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: frame(spark, sf, n) for n in _names(text)})


def with_views(*names):
    """`WITH ...` text defining the named views for DuckDB."""
    order = []

    def visit(name):
        for inner in _names(VIEWS[name]):
            if inner in VIEWS:
                visit(inner)
        if name not in order:
            order.append(name)
    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order)
    return f"WITH {body}\n"


# Orders against a copy with rewritten values. Some keys are negated, so they
# exist on one side only; the most expensive orders are posted twice.
VIEWS["orders_src"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  lpad(CAST(o_custkey AS STRING), 4, '0') AS acct_code,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL
       ELSE concat('note-', CAST(o_orderkey % 50 AS STRING)) END AS note
FROM {orders}"""

VIEWS["orders_tgt"] = """
SELECT CASE WHEN o_orderkey % 89 = 7 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 31 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 41 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 1009 = 0 THEN o_orderdate - INTERVAL '3650' DAY ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS STRING)
       ELSE lpad(CAST(o_custkey AS STRING), 4, '0') END AS acct_code,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 19 = 0 THEN 'nöte'
       ELSE concat('note-', CAST(o_orderkey % 50 AS STRING)) END AS note
FROM (SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_totalprice > 495000) AS posted"""

# The first row of every key, as all key-based checks see it.
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                 "acct_code", "note"]


def first_rows(view, keys, columns):
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn "
            f"FROM {{{view}}}) AS ranked WHERE rn = 1")


VIEWS["orders_src1"] = first_rows("orders_src", ["o_orderkey"], ORDER_COLUMNS)
VIEWS["orders_tgt1"] = first_rows("orders_tgt", ["o_orderkey"], ORDER_COLUMNS)

# Line items by (order, line), which is not unique.
VIEWS["lines_src"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS qty,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag, l_linestatus
FROM {lineitem}"""

VIEWS["lines_tgt"] = """
SELECT CASE WHEN l_partkey % 61 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS l_orderkey, l_linenumber,
  l_partkey, l_suppkey, CAST(l_quantity AS INT) AS qty,
  CASE WHEN l_suppkey % 23 = 0 THEN CAST(l_extendedprice + 1 AS DECIMAL(18,2))
       ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
  CASE WHEN l_suppkey % 17 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_suppkey % 19 = 0 THEN concat(' ', l_linestatus, ' ') ELSE l_linestatus END AS l_linestatus
FROM {lineitem}"""

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "price", "l_returnflag", "l_linestatus"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
VIEWS["lines_src1"] = first_rows("lines_src", LINE_KEYS, LINE_COLUMNS)
VIEWS["lines_tgt1"] = first_rows("lines_tgt", LINE_KEYS, LINE_COLUMNS)

# Events with missing, empty and oddly written values.
VIEWS["events_src"] = """
SELECT event_id, ts, user_id,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END AS event_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE props END AS props
FROM {events}"""

VIEWS["events_tgt"] = """
SELECT event_id, ts + INTERVAL '1' DAY AS ts, user_id,
  CASE WHEN event_id % 46 = 0 THEN '' ELSE event_type END AS event_type,
  CASE WHEN event_id % 22 = 0 THEN NULL ELSE value END AS value, props
FROM {events}"""

# A number written in many ways, and odd text.
VIEWS["written"] = """
SELECT event_id, CAST(user_id AS BIGINT) AS number,
  CASE event_id % 10
    WHEN 0 THEN CAST(user_id AS STRING)
    WHEN 1 THEN concat(' ', CAST(user_id AS STRING), '.0 ')
    WHEN 2 THEN concat('00', CAST(user_id AS STRING))
    WHEN 3 THEN concat('+', CAST(user_id AS STRING))
    WHEN 4 THEN concat('-', CAST(user_id AS STRING), '.50')
    WHEN 5 THEN concat(CAST(user_id AS STRING), '.')
    WHEN 6 THEN concat(' ', event_type, '  ')
    WHEN 7 THEN ''
    WHEN 8 THEN NULL
    ELSE concat('-', CAST(user_id AS STRING)) END AS written
FROM {events}"""

# Check results as a long history: one row per line item.
VIEWS["history"] = """
SELECT concat('run-', CAST(l_suppkey % 40 AS STRING)) AS validation_name,
  l_orderkey * 100000 + l_partkey AS ordinal,
  CASE l_linenumber WHEN 1 THEN 'record_count_check' WHEN 2 THEN 'null_check' WHEN 3 THEN 'duplicate_check'
    WHEN 4 THEN 'data_validation' WHEN 5 THEN 'primary_key_match' WHEN 6 THEN 'checksum_check'
    ELSE 'column_count_check' END AS validation,
  CASE WHEN l_suppkey % 40 = 3 AND l_returnflag = 'R' THEN 'INFO'
    WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_linestatus = 'F' THEN 'PASS' ELSE 'SKIP' END AS result,
  CASE WHEN l_linenumber = 4 THEN concat('col_', CAST(l_partkey % 30 AS STRING)) ELSE '' END AS column,
  concat('l_orderkey=', CAST(l_orderkey AS STRING)) AS pk,
  concat('line ', CAST(l_linenumber AS STRING), ' of order ', CAST(l_orderkey AS STRING),
         repeat(' differs', CAST(l_quantity AS INT))) AS detail,
  concat('''', CAST(CAST(l_quantity AS INT) AS STRING), '''') AS source_value,
  concat('''', repeat('x', CAST(l_quantity AS INT)), CAST(l_linenumber AS STRING), '''') AS target_value
FROM {lineitem}"""

# Dashboard measurements: one row per event.
VIEWS["samples"] = """
SELECT concat('dash-', CAST(user_id AS STRING)) AS dashboard_label,
  concat('https://bi.example/', CAST(user_id AS STRING)) AS dashboard_url,
  CAST(event_id AS BIGINT) AS iteration,
  CASE WHEN event_id % 2 = 0 THEN 'cold' ELSE 'warm' END AS load_mode,
  CASE event_type WHEN 'view' THEN 'full_dashboard_load' WHEN 'purchase' THEN 'filter_refresh'
    ELSE 'chart_load' END AS metric_type,
  CASE event_type WHEN 'view' THEN '' WHEN 'purchase' THEN 'Region'
    ELSE concat(event_type, '-', CAST(event_id % 4 AS STRING)) END AS chart_name,
  CAST(floor(value * 200) AS DOUBLE) AS value_ms, event_type <> 'error' AS rendered
FROM {events}"""

VIEWS["limits"] = """
SELECT concat('dash-', CAST(c_custkey AS STRING)) AS dashboard_label,
  CAST(9000 + c_nationkey * 100 AS DOUBLE) AS first_render_ms,
  CAST(11000 - c_nationkey * 50 AS DOUBLE) AS interaction_ms
FROM {customer}"""

# Text elements with styling, one per part.
VIEWS["elements"] = """
SELECT concat('tab-', CAST(p_partkey % 50 AS STRING)) AS tab, CAST(p_partkey AS BIGINT) AS element, p_name AS text,
  CASE p_size % 4 WHEN 0 THEN 'Arial, sans-serif' WHEN 1 THEN 'Tableau Book' WHEN 2 THEN '' ELSE 'Comic Sans' END
    AS font_family,
  concat(CAST(8 + p_size % 6 AS STRING), 'px') AS font_size,
  CASE WHEN p_size = 7 THEN 'transparent' ELSE concat('rgb(', CAST(p_partkey % 3 * 100 AS STRING), ', ',
    CAST(p_size % 2 * 255 AS STRING), ', 0)') END AS rgb
FROM {part}"""

# Page lists: a workbook per host, a page per web page.
VIEWS["pages_a"] = """
SELECT CAST(page_id % 9 AS BIGINT) AS workbook, page_id AS ordinal, concat('Page ', CAST(page_id AS STRING)) AS name
FROM {pages}"""

VIEWS["pages_b"] = """
SELECT CAST(page_id % 9 AS BIGINT) AS workbook,
  CASE WHEN page_id % 20 = 3 THEN page_id * 10 + 271 ELSE page_id * 10 END AS ordinal,
  concat(CASE WHEN page_id % 4 = 0 THEN 'PAGE ' ELSE 'Page ' END,
    CASE WHEN page_id % 25 = 6 THEN 'new ' ELSE '' END, CAST(page_id AS STRING)) AS name
FROM {pages}"""
