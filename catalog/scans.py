"""Reading and writing: files, tables, queries, archives, result sinks.

File queries first write a whole table to the shared folder in the format in
question and then read it back.
"""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from catalog.registry import frame, query, table, with_views
from twinframe import sinks
from twinframe.operators import dashboards, profile, summaries
from twinframe.operators.pushdown import keep_pushed_keys
from twinframe.shared import new_path
from twinframe.sources import files, tables, workbooks


@query("scan_parquet", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
  strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2""")
def scan_parquet(spark, sf):
    return (files.read_file(spark, f"{sf}/lineitem.parquet").where("l_discount >= 0.05")
            .groupBy("l_returnflag", "l_linestatus")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
                 F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_ship")))


@query("scan_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000")
def scan_table(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("twin_orders")
    return tables.read_table(spark, table="twin_orders", where="WHERE o_totalprice > 250000",
                             columns=["o_totalprice", "o_orderkey", "o_orderstatus", "unknown"])


OPEN_ORDERS = """
WITH spent AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
  FROM {o} GROUP BY o_custkey)
SELECT c_custkey, lower(c_mktsegment) AS segment, CASE WHEN n > 10 THEN 'often' WHEN n > 0 THEN 'rarely' ELSE 'never' END
  AS buys, total FROM {c} LEFT JOIN spent ON o_custkey = c_custkey"""


@query("scan_query", OPEN_ORDERS.format(o="orders", c="customer"))
def scan_query(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("twin_orders")
    table(spark, sf, "customer").createOrReplaceTempView("twin_customer")
    return tables.read_table(spark, query=OPEN_ORDERS.format(o="twin_orders", c="twin_customer"))


@query("scan_column_subset", "SELECT c_custkey, c_mktsegment FROM customer")
def scan_column_subset(spark, sf):
    return tables.select_columns(table(spark, sf, "customer"), ["C_MKTSEGMENT", "c_custkey", "no_such_column"])


@query("scan_where", "SELECT * FROM part WHERE p_size > 40 OR p_type = 'SMALL'")
def scan_where(spark, sf):
    return table(spark, sf, "part").where(tables.normalize_where("  where p_size > 40 OR p_type = 'SMALL' "))


@query("scan_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def scan_limit(spark, sf):
    # The row cap is the feature; the order makes it repeatable.
    table(spark, sf, "orders").createOrReplaceTempView("twin_orders")
    return tables.read_table(
        spark, query="SELECT o_orderkey, o_totalprice FROM twin_orders ORDER BY o_totalprice DESC, o_orderkey",
        limit="100")


@query("scan_pk_pushdown", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def scan_pk_pushdown(spark, sf):
    wanted = table(spark, sf, "customer").where("c_acctbal > 5000")
    return keep_pushed_keys(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), wanted, ["c_custkey"], ["o_custkey"])


@query("scan_pk_pushdown_literal", """
SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN
  (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')""")
def scan_pk_pushdown_literal(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return keep_pushed_keys(table(spark, sf, "supplier"), nations, ["n_nationkey"], ["s_nationkey"]).select("s_suppkey", "s_name")


@query("scan_pk_pushdown_composite", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 25)""")
def scan_pk_pushdown_composite(spark, sf):
    lines = table(spark, sf, "lineitem")
    return keep_pushed_keys(lines.select("l_orderkey", "l_linenumber", "l_partkey"), lines.where("l_quantity > 25"),
                            ["l_orderkey", "l_linenumber"])


@query("scan_pk_pushdown_nulls", with_views("events_src") + """
SELECT event_id, event_type, value FROM events_src t WHERE EXISTS (
  SELECT 1 FROM events_src k WHERE k.event_id % 5 = 0
  AND k.event_type IS NOT DISTINCT FROM t.event_type AND k.value IS NOT DISTINCT FROM t.value)""")
def scan_pk_pushdown_nulls(spark, sf):
    events = frame(spark, sf, "events_src")
    return keep_pushed_keys(events.select("event_id", "event_type", "value"), events.where("event_id % 5 = 0"), ["event_type", "value"])


def _exported(df, spark, label, **options):
    path = new_path(spark, label)
    df.write.options(header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
                     ignoreTrailingWhiteSpace=False, **options).csv(path)
    return path


@query("scan_csv", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, NULLIF(CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END, '') AS source,
  'NA' AS marker FROM documents""")
def scan_csv(spark, sf):
    documents = table(spark, sf, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("source")).alias("Source"),
        F.lit("NA").alias("marker"))
    return files.read_file(spark, _exported(documents, spark, "csv"), format="csv")


@query("scan_csv_encoding", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, concat('Zürich-', c_name, '-é') AS label FROM customer""")
def scan_csv_encoding(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Zürich-"), "c_name", F.lit("-é")).alias("label"))
    return files.read_file(spark, _exported(rows, spark, "latin", encoding="ISO-8859-1"), format="csv")


@query("scan_csv_bare_quotes", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, concat(p_size, '"in') AS size, concat(p_brand, '" ', p_size, '"') AS label FROM part""")
def scan_csv_bare_quotes(spark, sf):
    """Quotes inside a field that does not start with one are text."""
    inch = lambda c: F.concat(c, F.lit('"'))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(inch(F.col("p_size").cast("string")), F.lit("in")).alias("size"),
                                           F.concat(inch("p_brand"), F.lit(" "), inch(F.col("p_size").cast("string"))).alias("label"))
    path = new_path(spark, "bare")
    rows.write.options(header=True, quote="").csv(path)
    return files.read_file(spark, path, format="csv")


@query("scan_delimited", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def scan_delimited(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return files.read_file(spark, _exported(rows, spark, "bar", sep="|"), format="csv", sep="|", multi_line=False)


def _json_documents(df, spark, label, key, body, width=1000):
    """Files of one JSON document each, holding the rows of a key range."""
    path = new_path(spark, label)
    (df.groupBy(F.floor(F.col(key) / width).alias("part")).agg(body.alias("value"))
     .write.partitionBy("part").text(path))
    return path


@query("scan_json", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def scan_json(spark, sf):
    rows = table(spark, sf, "customer")
    record = F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = _json_documents(rows, spark, "json", "c_custkey", F.to_json(F.collect_list(record)))
    read = files.read_file(spark, path, format="json")
    return read.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


@query("scan_json_index", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_json_index(spark, sf):
    rows = table(spark, sf, "customer")
    entry = F.struct(F.col("c_custkey").cast("string"), F.struct(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    path = _json_documents(rows, spark, "json", "c_custkey", F.to_json(F.map_from_entries(F.collect_list(entry))))
    return files.read_file(spark, path, format="json", json_orient="index")


@query("scan_json_columns", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer")
def scan_json_columns(spark, sf):
    rows = table(spark, sf, "customer")
    by_row = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), c)))
    body = F.to_json(F.struct(by_row(F.col("c_custkey").cast("string")).alias("key"), by_row(F.col("c_name")).alias("name")))
    path = _json_documents(rows, spark, "json", "c_custkey", body)
    return files.read_file(spark, path, format="json", json_orient="columns")


@query("scan_json_values", "SELECT CAST(c_custkey AS VARCHAR) AS \"0\", c_name AS \"1\" FROM customer")
def scan_json_values(spark, sf):
    rows = table(spark, sf, "customer")
    entry = F.array(F.col("c_custkey").cast("string"), "c_name")
    path = _json_documents(rows, spark, "json", "c_custkey", F.to_json(F.collect_list(entry)))
    return files.read_file(spark, path, format="json", json_orient="values")


@query("scan_csv_short_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def scan_csv_short_rows(spark, sf):
    """Every third row lacks its last field."""
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(",", "c_custkey", "c_name")).otherwise(
        F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment"))
    body = F.concat(F.lit("c_custkey,c_name,c_mktsegment\n"), F.array_join(F.collect_list(line), "\n"))
    path = new_path(spark, "short-rows")
    rows = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(body.alias("value"))
    rows.write.partitionBy("part").text(path)
    return files.read_csv(spark, f"{path}/*", multi_line=False)


@query("scan_csv_mixed_encodings", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, concat('Zürich-', c_name, '-é') AS label FROM customer""")
def scan_csv_mixed_encodings(spark, sf):
    """One folder with files in two encodings."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Zürich-"), "c_name", F.lit("-é")).alias("label"))
    path = new_path(spark, "mixed")
    for rest, encoding in ((0, "ISO-8859-1"), (1, "UTF-8")):
        rows.where(F.col("c_custkey") % 2 == rest).write.mode("append").options(header=True, encoding=encoding).csv(path)
    return files.read_file(spark, path, format="csv")


@query("scan_json_lines", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def scan_json_lines(spark, sf):
    path = new_path(spark, "json-lines")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.json(path)
    read = files.read_file(spark, path, format="json")
    return read.select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


@query("scan_json_columns_files", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer")
def scan_json_columns_files(spark, sf):
    """Several files with the same row labels."""
    label = (F.col("c_custkey") % 100).cast("string")
    by_row = lambda c: F.map_from_entries(F.collect_list(F.struct(label, c)))
    body = F.to_json(F.struct(by_row(F.col("c_custkey").cast("string")).alias("key"), by_row(F.col("c_name")).alias("name")))
    path = _json_documents(table(spark, sf, "customer"), spark, "json", "c_custkey", body, width=100)
    return files.read_file(spark, path, format="json", json_orient="columns")


@query("sink_reports_of_like_names", """
SELECT 'one' AS run, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation
UNION ALL SELECT 'two', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_nationkey % 2 = 0""")
def sink_reports_of_like_names(spark, sf):
    """Two reports of one moment whose names differ only in what a path cannot hold."""
    rows, folder, now = table(spark, sf, "nation").select("n_nationkey", "n_name"), new_path(spark, "reports"), datetime.datetime.now()
    one = sinks.write_report(rows, folder, "A/B", now)
    two = sinks.write_report(rows.where("n_nationkey % 2 = 0"), folder, "a b", now)
    read = lambda path, run: files.read_csv(spark, path).select(F.lit(run).alias("run"), "n_nationkey", "n_name")
    return read(one, "one").union(read(two, "two"))


def archives(spark, sf):
    """A workbook archive per customer with two data sources and an embedded text file.

    The narrow rows are dealt out first: a table stored in one piece would be built and read by one task.
    """
    rows = table(spark, sf, "customer").select(
        F.concat("c_name", F.lit(".twbx")).alias("path"), "c_custkey", "c_mktsegment", "c_nationkey").repartition(
        4 * spark.sparkContext.defaultParallelism)

    def build(batches):
        import io
        import zipfile
        for batch in batches:
            packed = []
            for key, segment, nation in zip(batch["c_custkey"], batch["c_mktsegment"], batch["c_nationkey"]):
                record = "".join(
                    f"<metadata-record><local-name>[{n}]</local-name><local-type>{t}</local-type></metadata-record>"
                    for n, t in (("System Time", "date"), (f"Sales {nation}", "real"), ("Region", "string")))
                xml = (f"<workbook name='{segment}'><datasources><datasource name='Parameters'/>"
                       f"<datasource caption='{segment} data' name='fed'>{record}</datasource>"
                       f"<datasource name='plain'><column name='[Key]' datatype='integer'/></datasource></datasources>"
                       + "<worksheet/>" * (nation % 3 + 1) + "<dashboard/></workbook>")
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("book.twb", xml)
                    if nation % 2:
                        z.writestr("Data/rows.csv", f"Key,Segment\n{key},{segment}\n{key + 1},\n")
                packed.append(out.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": packed})

    return rows.mapInPandas(build, "path string, content binary")


@query("scan_workbook_catalog", """
SELECT concat(c_name, '.twbx') AS path, concat(c_mktsegment, ' data') AS datasource_name, column_name, datatype,
  concat('[', column_name, ']') AS raw_name, 'metadata-record' AS found_by
FROM (SELECT *, unnest([concat('Sales ', c_nationkey), 'Region']) AS column_name, unnest(['real', 'string']) AS datatype
      FROM customer) AS listed
UNION ALL SELECT concat(c_name, '.twbx'), 'plain', 'Key', 'integer', '[Key]', 'column-element' FROM customer""")
def scan_workbook_catalog(spark, sf):
    return workbooks.workbook_catalog(archives(spark, sf)).drop("position")


@query("workbook_inventory", """
SELECT concat(c_name, '.twbx') AS path, c_mktsegment AS workbook_name, 2 AS datasource_count,
  c_nationkey % 3 + 1 AS worksheet_count, 1 AS dashboard_count, FALSE AS has_hyper, FALSE AS has_tde,
  c_nationkey % 2 = 1 AS has_csv FROM customer""")
def workbook_inventory(spark, sf):
    return workbooks.workbook_inventory(archives(spark, sf)).drop("file_size")


@query("scan_workbook_embedded_csv", """
SELECT concat(c_name, '.twbx') AS path, 0 AS row, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment
FROM customer WHERE c_nationkey % 2 = 1
UNION ALL SELECT concat(c_name, '.twbx'), 1, CAST(c_custkey + 1 AS VARCHAR), NULL FROM customer WHERE c_nationkey % 2 = 1""")
def scan_workbook_embedded_csv(spark, sf):
    return workbooks.embedded_frame(archives(spark, sf), ["key", "segment"])


RESULTS = ["validation", "result", "column", "pk", "detail", "source_value", "target_value"]


def history(spark, sf):
    return frame(spark, sf, "history")


@query("sink_results", with_views("history") + "SELECT 'run 1' AS run_id, "
       + ", ".join(f'"{c}"' for c in RESULTS) + " FROM history")
def sink_results(spark, sf):
    path = new_path(spark, "results")
    sinks.write_results(history(spark, sf).select(*RESULTS), path, "run 1")
    return spark.read.parquet(path).select("run_id", *RESULTS)


@query("sink_consolidated", with_views("history") + """
SELECT 'failed' AS validation_name, pk, detail FROM history WHERE result = 'FAIL'
UNION ALL SELECT 'all', pk, detail FROM history""")
def sink_consolidated(spark, sf):
    rows = history(spark, sf)
    named = [("failed", summaries.by_status(rows, "FAIL").select("pk", "detail")), ("all", rows.select("pk", "detail"))]
    path = new_path(spark, "consolidated")
    sinks.write_csv(summaries.consolidate(named), path, single_file=False)
    return files.read_csv(spark, path, multi_line=False)


SUMMARY = """
SELECT validation_name, count(*) FILTER (result = 'PASS') AS passed, count(*) FILTER (result = 'FAIL') AS failed,
  count(*) AS total, CASE WHEN count(*) FILTER (result = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM history GROUP BY validation_name"""


@query("sink_summary", with_views("history") + SUMMARY)
def sink_summary(spark, sf):
    path = new_path(spark, "summary")
    sinks.write_results(summaries.suite_summary(history(spark, sf)), path, "now")
    return spark.read.parquet(path).drop("run_id")


@query("sink_perf_long", with_views("samples", "limits") + """
SELECT s.dashboard_label, dashboard_url, CAST(iteration AS VARCHAR) AS iteration,
  CASE WHEN metric_type = 'filter_refresh' THEN 'warm' ELSE load_mode END AS load_mode, metric_type,
  NULLIF(CASE WHEN metric_type = 'full_dashboard_load' THEN '' ELSE chart_name END, '') AS chart_name,
  CAST(CAST(value_ms AS BIGINT) AS VARCHAR) AS value_ms,
  CASE WHEN metric_type = 'full_dashboard_load' AND load_mode = 'cold' THEN CAST(CAST(coalesce(first_render_ms, 15000) AS BIGINT) AS VARCHAR)
       WHEN metric_type = 'filter_refresh' THEN CAST(CAST(coalesce(interaction_ms, 8000) AS BIGINT) AS VARCHAR) END AS threshold_ms,
  CASE WHEN metric_type = 'full_dashboard_load' AND load_mode = 'cold'
         THEN CASE WHEN value_ms <= coalesce(first_render_ms, 15000) THEN 'True' ELSE 'False' END
       WHEN metric_type = 'filter_refresh' THEN CASE WHEN value_ms <= coalesce(interaction_ms, 8000) THEN 'True' ELSE 'False' END
       WHEN metric_type = 'chart_load' AND NOT rendered THEN 'NOT_RENDERED' END AS pass
FROM samples s LEFT JOIN limits l ON s.dashboard_label = l.dashboard_label""")
def sink_perf_long(spark, sf):
    path = new_path(spark, "timings")
    report = dashboards.timing_report(frame(spark, sf, "samples"), frame(spark, sf, "limits"))
    sinks.write_csv(report, path, single_file=False)
    return files.read_csv(spark, path, multi_line=False)


@query("sink_count_report", """
SELECT 'orders' AS name, 'orders.csv' AS csv_file, CAST(count(*) AS VARCHAR) AS csv_rows, '6' AS csv_cols,
  'orders' AS table, CAST(count(*) AS VARCHAR) AS table_rows, '6' AS table_cols, 'YES' AS rows_match,
  'YES' AS cols_match, 'PASSED' AS status FROM orders""")
def sink_count_report(spark, sf):
    orders = table(spark, sf, "orders")
    exported = files.read_csv(spark, _exported(orders, spark, "orders"), multi_line=False)
    path = new_path(spark, "counts")
    sinks.write_csv(profile.count_check([("orders", exported, "orders.csv", orders, "orders")]), path)
    return files.read_csv(spark, path, multi_line=False)
