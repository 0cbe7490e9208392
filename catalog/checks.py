"""Structural checks, profiles and value checks."""

from pyspark.sql import functions as F

from catalog.joins import ORDER_DIFFS, ORDER_KEYS, POSITIONS, SORTED, _line_hash, lines, orders
from catalog.registry import LINE_KEYS, ORDER_COLUMNS, frame, query, table, with_views
from twinframe.operators import compare, keys, profile
from twinframe.operators.align import common_columns

EVENT_COLUMNS = ["event_id", "event_type", "props", "ts", "user_id", "value"]


def events(spark, sf):
    return frame(spark, sf, "events_src"), frame(spark, sf, "events_tgt")


EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"}


@query("profile_columns", with_views("events_src") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS ordinal, '{t}' AS dtype, count(*) - count({c}) AS null_count, "
    f"count(*) AS row_count FROM events_src" for i, (c, t) in enumerate(EVENT_TYPES.items())))
def profile_columns(spark, sf):
    return profile.profile_columns(frame(spark, sf, "events_src")).select(
        "column", "ordinal", "dtype", "null_count", "row_count")


@query("agg_record_count", with_views("orders_src", "orders_tgt") + """
SELECT (SELECT count(*) FROM orders_src) AS source_rows, (SELECT count(*) FROM orders_tgt) AS target_rows,
  (SELECT count(*) FROM orders_src) = (SELECT count(*) FROM orders_tgt) AS matches""")
def agg_record_count(spark, sf):
    return profile.record_counts(*orders(spark, sf))


@query("agg_column_count", """
SELECT 'orders' AS name, 6 AS source_columns, 8 AS target_columns, 6 AS common_columns, TRUE AS passes,
  count(*) AS source_rows FROM orders""")
def agg_column_count(spark, sf):
    source, target = frame(spark, sf, "orders"), frame(spark, sf, "orders_tgt")
    c = profile.column_counts(source, target)
    return source.agg(F.count(F.lit(1)).alias("source_rows")).select(
        F.lit("orders").alias("name"), F.lit(c["source_columns"]).alias("source_columns"),
        F.lit(c["target_columns"]).alias("target_columns"), F.lit(c["common_columns"]).alias("common_columns"),
        F.lit(c["passes"]).alias("passes"), "source_rows")


# Lines against lines written as text: every column but the flags changes its type.
_TYPES = {"l_linenumber": ("int", "numeric"), "l_linestatus": ("string", "string"),
          "l_orderkey": ("bigint", "numeric"), "l_partkey": ("bigint", "numeric"),
          "l_returnflag": ("string", "string"), "l_suppkey": ("bigint", "numeric"),
          "price": ("decimal(18,2)", "numeric"), "qty": ("int", "numeric")}


@query("agg_type_check", with_views("lines_src") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS source_type, 'string' AS target_type, {str(k == 'string').upper()} AS compatible, "
    f"count(*) - count({c}) AS null_count FROM lines_src" for c, (t, k) in _TYPES.items()))
def agg_type_check(spark, sf):
    source = frame(spark, sf, "lines_src")
    target = source.select(*[F.col(c).cast("string").alias(c) for c in source.columns])
    columns = common_columns(source, target)
    nulls = profile.null_and_empty_counts(target, columns).select("column", "null_count")
    return profile.type_check(source, target, columns).join(nulls, "column").select(
        "column", "source_type", "target_type", "compatible", "null_count")


@query("agg_duplicates", with_views("lines_tgt") + """
, groups AS (SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lines_tgt GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'first' AS what, l_orderkey, l_linenumber, n_rows FROM (SELECT * FROM groups ORDER BY l_orderkey, l_linenumber LIMIT 5) AS f
UNION ALL SELECT 'all', count(*), 0, CAST(sum(n_rows) AS BIGINT) FROM groups""")
def agg_duplicates(spark, sf):
    groups = keys.duplicates(frame(spark, sf, "lines_tgt"), LINE_KEYS)
    first = keys.first_n(groups, LINE_KEYS, 5).select(F.lit("first").alias("what"), *LINE_KEYS, "n_rows")
    total = groups.agg(F.count(F.lit(1)).alias("l_orderkey"), F.sum("n_rows").alias("n_rows")).select(
        F.lit("all").alias("what"), "l_orderkey", F.lit(0).alias("l_linenumber"), "n_rows")
    return first.unionByName(total)


def _per_column(columns, select, views):
    return with_views(*views) + " UNION ALL ".join(select(c) for c in columns)


def _both_counts(expr, name):
    return lambda c: (f"SELECT '{c}' AS column, (SELECT {expr.format(c=c)} FROM events_src) AS source_{name}, "
                      f"(SELECT {expr.format(c=c)} FROM events_tgt) AS target_{name}")


@query("agg_nulls", _per_column(EVENT_COLUMNS, _both_counts("count(*) - count({c})", "nulls"),
                                ["events_src", "events_tgt"]))
def agg_nulls(spark, sf):
    return profile.null_check(*events(spark, sf), EVENT_COLUMNS).select("column", "source_nulls", "target_nulls")


@query("agg_empty_strings", with_views("events_src", "events_tgt") + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{s}' AS side, 'event_type' AS column, event_id,
    (SELECT count(*) FROM events_{s} WHERE event_type = '') AS empties
    FROM events_{s} WHERE event_type = '' ORDER BY event_id LIMIT 3) AS {s}3""" for s in ("src", "tgt")))
def agg_empty_strings(spark, sf):
    def side(df, name):
        found = profile.empty_string_examples(df, EVENT_COLUMNS, ["event_id"])
        counts = profile.null_and_empty_counts(df, EVENT_COLUMNS).select("column", F.col("empty_count").alias("empties"))
        return found.join(counts, "column").select(F.lit(name).alias("side"), "column", "event_id", "empties")
    source, target = events(spark, sf)
    return side(source, "src").unionByName(side(target, "tgt"))


MATCH = with_views("lines_src", "lines_tgt") + """
, s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lines_src),
t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lines_tgt),
m AS (SELECT count(*) AS common FROM s JOIN t USING (l_orderkey, l_linenumber))
"""


@query("agg_pk_match", MATCH + """
SELECT common, (SELECT count(*) FROM s) - common AS source_only, (SELECT count(*) FROM t) - common AS target_only
FROM m""")
def agg_pk_match(spark, sf):
    return keys.key_match(keys.key_sets(*lines(spark, sf), LINE_KEYS))


@query("agg_symmetric_difference", MATCH + """
SELECT (SELECT count(*) FROM s) - common AS source_only, (SELECT count(*) FROM t) - common AS target_only,
  (SELECT count(*) FROM s) + (SELECT count(*) FROM t) - 2 * common AS difference FROM m""")
def agg_symmetric_difference(spark, sf):
    return keys.symmetric_difference(keys.key_sets(*lines(spark, sf), LINE_KEYS))


@query("agg_value_mismatch", with_views("orders_src1", "orders_tgt1") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS compared, count(*) FILTER ({test}) AS mismatches "
    f"FROM orders_src1 s JOIN orders_tgt1 t USING (o_orderkey)" for c, test in ORDER_DIFFS.items()))
def agg_value_mismatch(spark, sf):
    return compare.mismatch_counts(keys.key_pair(*orders(spark, sf), ORDER_KEYS, how="inner"))


_LINE_TESTS = {c: f"s.{c} <> t.{c}" for c in SORTED}
_LINE_TESTS["l_linestatus"] = "trim(s.l_linestatus) <> trim(t.l_linestatus)"


@query("agg_value_mismatch_composite", with_views("lines_src1", "lines_tgt1") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS compared, "
    f"count(*) FILTER ({'FALSE' if c in LINE_KEYS else test}) AS mismatches "
    f"FROM lines_src1 s JOIN lines_tgt1 t USING (l_orderkey, l_linenumber)" for c, test in _LINE_TESTS.items()))
def agg_value_mismatch_composite(spark, sf):
    return compare.mismatch_counts(keys.key_pair(*lines(spark, sf), LINE_KEYS, how="inner"))


# The text of a line column compares by value: all but the flags are numbers without padding.
@query("agg_positional_mismatch", POSITIONS + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) AS compared, count(*) FILTER ({test}) AS mismatches "
    f"FROM sp s JOIN tp t USING (position)" for c, test in _LINE_TESTS.items()))
def agg_positional_mismatch(spark, sf):
    return compare.positional_mismatch_counts(compare.positional_segments(*lines(spark, sf)))


@query("agg_positional_examples", POSITIONS + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT position, '{c}' AS column, concat('''', s.{c}, '''') AS source_value, concat('''', t.{c}, '''') AS target_value "
    f"FROM sp s JOIN tp t USING (position) WHERE {test}" for c, test in _LINE_TESTS.items())
    + ") AS cells ORDER BY position, \"column\" LIMIT 100")
def agg_positional_examples(spark, sf):
    return compare.positional_mismatch_examples(compare.positional_segments(*lines(spark, sf)))


@query("agg_column_order", with_views("orders_src") + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {i} AS source_position, {sorted(ORDER_COLUMNS).index(c)} AS target_position, "
    f"{str(i == sorted(ORDER_COLUMNS).index(c)).upper()} AS matches, count({c}) AS non_null FROM orders_src"
    for i, c in enumerate(ORDER_COLUMNS)))
def agg_column_order(spark, sf):
    source = frame(spark, sf, "orders_src")
    target = frame(spark, sf, "orders_tgt").select(*sorted(ORDER_COLUMNS))
    counts = profile.null_and_empty_counts(source).select("column", (F.col("row_count") - F.col("null_count")).alias("non_null"))
    return profile.column_order(source, target).join(counts, "column")


@query("agg_column_specs", with_views("lines_src") + """
SELECT 'price' AS column, 'precision' AS kind, '18,2' AS source_value, '20,4' AS target_value, count(price) AS non_null
FROM lines_src""")
def agg_column_specs(spark, sf):
    source = frame(spark, sf, "lines_src")
    target = source.withColumn("price", F.col("price").cast("decimal(20,4)"))
    counts = profile.null_and_empty_counts(target).select("column", (F.col("row_count") - F.col("null_count")).alias("non_null"))
    return profile.column_specs(source, target, common_columns(source, target)).join(counts, "column")


@query("agg_distinct", _per_column(EVENT_COLUMNS, _both_counts("count(DISTINCT {c})", "distinct"),
                                   ["events_src", "events_tgt"]))
def agg_distinct(spark, sf):
    return profile.distinct_check(*events(spark, sf), EVENT_COLUMNS)


@query("agg_date_range", with_views("events_src", "events_tgt") + """
, r AS (SELECT (SELECT min(ts) FROM events_src) AS a, (SELECT max(ts) FROM events_src) AS b,
  (SELECT min(ts) FROM events_tgt) AS c, (SELECT max(ts) FROM events_tgt) AS d)
SELECT 'ts' AS column, strftime(a, '%Y-%m-%d %H:%M:%S') AS source_min, strftime(b, '%Y-%m-%d %H:%M:%S') AS source_max,
  strftime(c, '%Y-%m-%d %H:%M:%S') AS target_min, strftime(d, '%Y-%m-%d %H:%M:%S') AS target_max,
  a = c AND b = d AS matches FROM r""")
def agg_date_range(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return profile.date_range_check(*events(spark, sf), EVENT_COLUMNS).select(
        "column", *[text(c) for c in ("source_min", "source_max", "target_min", "target_max")], "matches")


@query("agg_date_range_text", """
SELECT 'due' AS column, '0001-01-01 00:00:00' AS source_min, '9999-12-31 00:00:00' AS source_max,
  '0001-01-01 00:00:00' AS target_min, strftime(max(o_orderdate) FILTER (o_orderkey % 50 > 1), '%Y-%m-%d 00:00:00') AS target_max,
  FALSE AS matches FROM orders""")
def agg_date_range_text(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    due = lambda last: F.when(F.col("o_orderkey") % 50 == 0, F.lit("0001-01-01")).when(F.col("o_orderkey") % 50 == 1, last).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    sides = [table(spark, sf, "orders").select("o_orderkey", due(last).alias("due")) for last in (F.lit("9999-12-31"), F.lit("0001-01-01"))]
    return profile.date_range_check(*sides, ["due"]).select(
        "column", *[text(c) for c in ("source_min", "source_max", "target_min", "target_max")], "matches")


def _text_sql(columns, hit):
    return with_views("orders_src1", "orders_tgt1") + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) AS hits, concat('o_orderkey=', CAST(min(o_orderkey) AS STRING)) AS pk,
        arg_min(s.{c}, o_orderkey) AS source_value, arg_min(t.{c}, o_orderkey) AS target_value
        FROM orders_src1 s JOIN orders_tgt1 t USING (o_orderkey) WHERE {hit.format(c=c)} HAVING count(*) > 0"""
        for c in columns)


TEXT_COLUMNS = ["o_orderstatus", "o_orderpriority", "acct_code", "note"]


def _text_check(spark, sf, rule):
    pair = keys.key_pair(*orders(spark, sf), ORDER_KEYS, how="inner")
    return compare.text_check(pair, [rule]).where("hits > 0").drop("validation")


@query("agg_case_diff", _text_sql(TEXT_COLUMNS, "lower(s.{c}) = lower(t.{c}) AND s.{c} <> t.{c}"))
def agg_case_diff(spark, sf):
    return _text_check(spark, sf, "case_sensitivity_check")


_ZERO = "(starts_with(s.{c}, '0') <> starts_with(t.{c}, '0')) AND regexp_replace(s.{c}, '0', '') = regexp_replace(t.{c}, '0', '')"


@query("agg_leading_zero", _text_sql(TEXT_COLUMNS, _ZERO))
def agg_leading_zero(spark, sf):
    return _text_check(spark, sf, "leading_zero_check")


@query("agg_special_chars", _text_sql(
    TEXT_COLUMNS, "(strlen(s.{c}) = length(s.{c})) <> (strlen(t.{c}) = length(t.{c}))"))
def agg_special_chars(spark, sf):
    return _text_check(spark, sf, "special_char_check")


@query("agg_checksum", with_views("lines_src1", "lines_tgt1") + f"""
SELECT count(*) AS compared, count(*) FILTER ({_line_hash('s')} <> {_line_hash('t')}) AS mismatches
FROM lines_src1 s JOIN lines_tgt1 t USING (l_orderkey, l_linenumber)""")
def agg_checksum(spark, sf):
    return compare.checksum_counts(compare.row_hashes(keys.key_pair(*lines(spark, sf), LINE_KEYS, how="inner")))


@query("agg_count_check", with_views("orders_src", "orders_tgt") + """
, c AS (SELECT (SELECT count(*) FROM orders_src) AS s, (SELECT count(*) FROM orders_tgt) AS t, (SELECT count(*) FROM orders) AS o)
SELECT 'same' AS name, 'orders.csv' AS csv_file, o AS csv_rows, 6 AS csv_cols, 'orders' AS table, o AS table_rows,
  6 AS table_cols, 'YES' AS rows_match, 'YES' AS cols_match, 'PASSED' AS status FROM c
UNION ALL SELECT 'posted', 'orders_src.csv', s, 8, 'orders_tgt', t, 8, 'NO', 'YES', 'FAILED' FROM c
UNION ALL SELECT 'wide', 'orders.csv', o, 6, 'orders_src', s, 8, 'YES', 'NO', 'FAILED' FROM c""")
def agg_count_check(spark, sf):
    plain, (source, target) = frame(spark, sf, "orders"), orders(spark, sf)
    return profile.count_check([
        ("same", plain, "orders.csv", plain, "orders"), ("posted", source, "orders_src.csv", target, "orders_tgt"),
        ("wide", plain, "orders.csv", source, "orders_src")])
