"""Key sets, joins and row selection."""

from pyspark.sql import functions as F

from catalog.registry import LINE_COLUMNS, LINE_KEYS, frame, query, with_views
from twinframe.operators import compare, hash_tree, keys
from twinframe.operators.pushdown import keep_pushed_keys

ORDER_KEYS = ["o_orderkey"]


def orders(spark, sf):
    return frame(spark, sf, "orders_src"), frame(spark, sf, "orders_tgt")


def lines(spark, sf):
    return frame(spark, sf, "lines_src"), frame(spark, sf, "lines_tgt")


@query("join_subset_target", with_views("orders_src", "orders_tgt") + """
SELECT * FROM orders_tgt WHERE o_orderkey IN (SELECT o_orderkey FROM orders_src)""")
def join_subset_target(spark, sf):
    return keys.subset_pair(*orders(spark, sf), ORDER_KEYS)[1]


@query("join_subset_source", with_views("orders_src", "orders_tgt") + """
SELECT * FROM orders_tgt WHERE o_orderkey IN (SELECT o_orderkey FROM orders_src)""")
def join_subset_source(spark, sf):
    source, target = orders(spark, sf)
    return keys.subset_pair(target, source, ORDER_KEYS)[0]


@query("join_sample_keys", with_views("lines_src") + """
, picked AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lines_src
  ORDER BY md5(concat('42|', CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING))), l_orderkey, l_linenumber
  LIMIT 500)
SELECT lines_src.* FROM lines_src JOIN picked USING (l_orderkey, l_linenumber)""")
def join_sample_keys(spark, sf):
    source = frame(spark, sf, "lines_src")
    return keys.keep_keys(source, keys.sample_keys(source, LINE_KEYS, 500), LINE_KEYS)


@query("join_filter_target_all_keys", with_views("lines_src", "lines_tgt") + """
SELECT t.* FROM lines_tgt t WHERE EXISTS (SELECT 1 FROM lines_src s
  WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)""")
def join_filter_target_all_keys(spark, sf):
    source, target = lines(spark, sf)
    return keep_pushed_keys(target, source, LINE_KEYS)


# A cell of the order pair after coercion, in DuckDB: only these columns differ by more than spelling.
ORDER_DIFFS = {
    "o_custkey": "s.o_custkey IS DISTINCT FROM t.o_custkey",
    "o_orderstatus": "s.o_orderstatus IS DISTINCT FROM t.o_orderstatus",
    "o_totalprice": "s.o_totalprice IS DISTINCT FROM t.o_totalprice",
    "o_orderdate": "s.o_orderdate IS DISTINCT FROM t.o_orderdate",
    "o_orderpriority": "s.o_orderpriority IS DISTINCT FROM t.o_orderpriority",
    "acct_code": "CAST(s.acct_code AS BIGINT) IS DISTINCT FROM CAST(t.acct_code AS BIGINT)",
    "note": "s.note IS DISTINCT FROM t.note",
    "o_orderkey": "FALSE",
}


def _order_text(side, column):
    c = f"{side}.{column}"
    if column == "o_totalprice":
        return f"CAST({c} AS VARCHAR)"
    if column in ("o_custkey", "o_orderkey"):
        return f"CAST({c} AS VARCHAR)"
    if column == "o_orderdate":
        return f"concat('''', strftime({c}, '%Y-%m-%d %H:%M:%S'), '''')"
    return f"CASE WHEN {c} IS NULL THEN 'nan' ELSE concat('''', {c}, '''') END"


ORDER_CELLS = " UNION ALL ".join(
    f"SELECT s.o_orderkey, '{c}' AS column, {_order_text('s', c)} AS source_value, {_order_text('t', c)} AS target_value "
    f"FROM orders_src1 s JOIN orders_tgt1 t USING (o_orderkey) WHERE {test}"
    for c, test in ORDER_DIFFS.items() if test != "FALSE")


@query("join_matched_values", with_views("orders_src1", "orders_tgt1") + f"""
SELECT concat('o_orderkey=', CAST(o_orderkey AS STRING)) AS pk, "column", source_value, target_value
FROM ({ORDER_CELLS}) AS cells""")
def join_matched_values(spark, sf):
    pair = keys.key_pair(*orders(spark, sf), ORDER_KEYS, how="inner")
    return compare.mismatches(pair).select("pk", "column", "source_value", "target_value")


def _missing_sql(this, other):
    return with_views("orders_src", "orders_tgt") + f"""
SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey FROM {this}) AS mine
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {other}) ORDER BY o_orderkey LIMIT 5"""


@query("join_source_only", _missing_sql("orders_src", "orders_tgt"))
def join_source_only(spark, sf):
    source, target = orders(spark, sf)
    return keys.first_n(keys.missing_keys(source, target, ORDER_KEYS), ORDER_KEYS, 5)


@query("join_target_only", _missing_sql("orders_tgt", "orders_src"))
def join_target_only(spark, sf):
    source, target = orders(spark, sf)
    return keys.first_n(keys.missing_keys(target, source, ORDER_KEYS), ORDER_KEYS, 5)


TEXT_LINES = "concat_ws('|', " + ", ".join(f"CAST({c} AS STRING)" for c in LINE_COLUMNS) + ")"
SORTED = sorted(LINE_COLUMNS)


def _positions_cte(view, name):
    """Rows of a view as text with their position in the text sort of all columns."""
    cells = ", ".join(f"coalesce(CAST({c} AS STRING), 'nan') AS {c}" for c in SORTED)
    return (f", {name} AS (SELECT *, row_number() OVER (ORDER BY {', '.join(SORTED)}) - 1 AS position "
            f"FROM (SELECT {cells} FROM {view}) AS texts)")


POSITIONS = with_views("lines_src", "lines_tgt") + _positions_cte("lines_src", "sp") + _positions_cte("lines_tgt", "tp")


@query("join_positional", POSITIONS + f"""
SELECT position, {', '.join(f's.{c} AS s_{c}, t.{c} AS t_{c}' for c in SORTED)}
FROM sp s JOIN tp t USING (position)""")
def join_positional(spark, sf):
    segments = compare.positional_segments(*lines(spark, sf))
    every = F.explode(F.sequence("position", F.col("position") + F.col("length") - 1)).alias("position")
    return segments.select(every, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in SORTED for p in "st"])


@query("join_row_pairs_first_n", with_views("orders_src1", "orders_tgt1") + """
, first_pairs AS (SELECT o_orderkey, s.o_orderstatus AS s_status, t.o_orderstatus AS t_status
  FROM orders_src1 s JOIN orders_tgt1 t USING (o_orderkey) ORDER BY o_orderkey LIMIT 100)
SELECT count(*) AS pairs, count(*) FILTER (lower(s_status) = lower(t_status) AND s_status <> t_status) AS hits
FROM first_pairs""")
def join_row_pairs_first_n(spark, sf):
    # The first 100 pairs are the feature: a quick look at the start of the data.
    pair = keys.key_pair(*orders(spark, sf), ORDER_KEYS, how="inner")
    first = keys.first_n(pair.matched(), pair.key_names, 100)
    hit = (F.lower("s.o_orderstatus") == F.lower("t.o_orderstatus")) & (
        F.col("s.o_orderstatus") != F.col("t.o_orderstatus"))
    return first.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(hit).alias("hits"))


def _line_hash(side):
    cells = [c for c in sorted(LINE_COLUMNS) if c not in LINE_KEYS]
    return "md5(concat_ws('|', " + ", ".join(f"CAST({side}.{c} AS STRING)" for c in cells) + "))"


@query("join_checksum", with_views("lines_src1", "lines_tgt1") + f"""
SELECT concat('l_orderkey=', CAST(l_orderkey AS STRING), ', l_linenumber=', CAST(l_linenumber AS STRING)) AS pk,
  {_line_hash('s')} AS source_hash, {_line_hash('t')} AS target_hash
FROM lines_src1 s JOIN lines_tgt1 t USING (l_orderkey, l_linenumber)""")
def join_checksum(spark, sf):
    pair = keys.key_pair(*lines(spark, sf), LINE_KEYS, how="inner")
    return compare.row_hashes(pair).select("pk", "source_hash", "target_hash")


@query("join_checksum_tree", with_views("lines_src1", "lines_tgt1") + f"""
SELECT concat('l_orderkey=', CAST(l_orderkey AS STRING), ', l_linenumber=', CAST(l_linenumber AS STRING)) AS pk,
  {_line_hash('s')} AS source_hash, {_line_hash('t')} AS target_hash
FROM lines_src1 s JOIN lines_tgt1 t USING (l_orderkey, l_linenumber) WHERE {_line_hash('s')} <> {_line_hash('t')}""")
def join_checksum_tree(spark, sf):
    return hash_tree.row_differences(*lines(spark, sf), LINE_KEYS)


@query("set_key_intersection", with_views("lines_src", "lines_tgt") + """
SELECT l_orderkey, l_linenumber FROM lines_src INTERSECT SELECT l_orderkey, l_linenumber FROM lines_tgt""")
def set_key_intersection(spark, sf):
    return keys.key_intersection(*lines(spark, sf), LINE_KEYS)


@query("set_key_difference", with_views("lines_src", "lines_tgt") + """
SELECT l_orderkey, l_linenumber FROM lines_src EXCEPT SELECT l_orderkey, l_linenumber FROM lines_tgt""")
def set_key_difference(spark, sf):
    return keys.key_difference(*lines(spark, sf), LINE_KEYS)


@query("set_row_difference", with_views("lines_src", "lines_tgt") + f"""
SELECT {', '.join(SORTED)} FROM lines_src EXCEPT ALL SELECT {', '.join(SORTED)} FROM lines_tgt""")
def set_row_difference(spark, sf):
    return keys.row_difference(*lines(spark, sf))


@query("set_distinct_keys", with_views("lines_src") + "SELECT DISTINCT l_orderkey, l_linenumber FROM lines_src")
def set_distinct_keys(spark, sf):
    return keys.distinct_keys(frame(spark, sf, "lines_src"), LINE_KEYS)


@query("win_first_per_key", with_views("lines_src1") + f"SELECT {', '.join(LINE_COLUMNS)} FROM lines_src1")
def win_first_per_key(spark, sf):
    return keys.first_per_key(frame(spark, sf, "lines_src"), LINE_KEYS)


@query("win_examples_per_column", with_views("orders_src1", "orders_tgt1") + f"""
SELECT "column", CAST(rn AS INTEGER) AS example, concat('o_orderkey=', CAST(o_orderkey AS STRING)) AS pk,
  source_value, target_value
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) AS rn FROM ({ORDER_CELLS}) AS cells) AS r
WHERE rn <= 3""")
def win_examples_per_column(spark, sf):
    return compare.mismatch_examples(keys.key_pair(*orders(spark, sf), ORDER_KEYS, how="inner"))


@query("win_examples_per_side", with_views("orders_src", "orders_tgt") + """
, one_sided AS (
  SELECT 'source_only' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders_src EXCEPT SELECT o_orderkey FROM orders_tgt) AS a
  UNION ALL
  SELECT 'target_only', o_orderkey FROM (SELECT o_orderkey FROM orders_tgt EXCEPT SELECT o_orderkey FROM orders_src) AS b)
SELECT side, CAST(rn AS INTEGER) AS example, concat('o_orderkey=', CAST(o_orderkey AS STRING)) AS pk
FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY o_orderkey) AS rn FROM one_sided) AS r WHERE rn <= 5""")
def win_examples_per_side(spark, sf):
    pair = keys.key_pair(*orders(spark, sf), ORDER_KEYS)
    found = compare.finding_examples(compare.findings(pair), pair)
    return found.where(F.col("kind").isin("source_only", "target_only")).select(
        F.col("kind").alias("side"), "example", "pk")


@query("sort_all_columns_text", POSITIONS + f"SELECT position, {', '.join(SORTED)} FROM sp")
def sort_all_columns_text(spark, sf):
    return compare.sorted_positions(frame(spark, sf, "lines_src"), SORTED)
