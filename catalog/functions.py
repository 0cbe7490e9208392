"""Scalar functions over whole columns."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import frame, query, table, with_views
from twinframe.functions import values

TEXT, LONG = T.StringType(), T.LongType()


def _number_sql(d):
    return (f"CASE WHEN abs({d}) < 9007199254740992 AND {d} = floor({d}) "
            f"THEN concat('n:', CAST(CAST({d} AS BIGINT) AS VARCHAR)) ELSE concat('n:', CAST({d} AS VARCHAR)) END")


def canon_sql(x):
    """The coercion of a text column in DuckDB."""
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    digits = f"regexp_replace({t}, '^[+-]?0*([0-9]+)$', '\\1')"
    whole = f"concat('n:', CASE WHEN {t} LIKE '-%' AND {digits} <> '0' THEN '-' ELSE '' END, {digits})"
    real = _number_sql(f"CAST(concat({t}, '0') AS DOUBLE)")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN {whole} "
            f"WHEN regexp_full_match({t}, '[+-]?[0-9]+\\.[0-9]*') THEN {real} ELSE concat('s:', {t}) END")


@query("fn_canon", with_views("written") + f"SELECT event_id, {canon_sql('written')} AS canon FROM written")
def fn_canon(spark, sf):
    return frame(spark, sf, "written").select("event_id", F.expr(values.canon("written", TEXT)).alias("canon"))


@query("fn_equal", with_views("written") + f"""
SELECT event_id, {canon_sql('written')} IS NOT DISTINCT FROM concat('n:', CAST(number AS VARCHAR)) AS equal FROM written""")
def fn_equal(spark, sf):
    return frame(spark, sf, "written").select(
        "event_id", (~F.expr(values.unequal("written", "number", TEXT, LONG))).alias("equal"))


@query("fn_format_pk", with_views("written") + """
SELECT event_id, concat('id=', CAST(event_id AS VARCHAR), ', code=',
  CASE WHEN written IS NULL THEN 'nan' ELSE concat('''', written, '''') END) AS pk FROM written""")
def fn_format_pk(spark, sf):
    key = [("id", "event_id", LONG), ("code", "written", TEXT)]
    return frame(spark, sf, "written").select("event_id", F.expr(values.format_key(key)).alias("pk"))


@query("fn_truncate", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 97), '...') ELSE text END AS short
FROM documents""")
def fn_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(values.truncate("text")).alias("short"))


@query("fn_safe_repr", """
SELECT doc_id, CASE WHEN length(text) > 98 THEN concat('''', substring(text, 1, 96), '...') ELSE concat('''', text, '''') END
  AS shown FROM documents""")
def fn_safe_repr(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(values.safe_repr("text", TEXT)).alias("shown"))


@query("fn_row_hash", """
SELECT doc_id, md5(concat_ws('|', text, lang, source)) AS md5_hash, sha256(concat_ws('|', text, lang, source)) AS sha256_hash
FROM documents""")
def fn_row_hash(spark, sf):
    cells = [(c, TEXT) for c in ("text", "lang", "source")]
    return table(spark, sf, "documents").select(
        "doc_id", F.expr(values.row_hash(cells)).alias("md5_hash"), F.expr(values.row_hash(cells, "sha256")).alias("sha256_hash"))


@query("fn_is_ascii", "SELECT doc_id, strlen(text) = length(text) AS ascii FROM documents")
def fn_is_ascii(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(values.is_ascii("text")).alias("ascii"))


DATE_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN {ts} WHEN 1 THEN {day} WHEN 2 THEN concat(' ', {day}, 'x')
  WHEN 3 THEN o_orderpriority ELSE '' END"""


@query("fn_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""")
def fn_parse_date(spark, sf):
    text = F.expr(DATE_TEXT.format(ts="date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')",
                                   day="date_format(o_orderdate, 'yyyy-MM-dd')"))
    written = table(spark, sf, "orders").select("o_orderkey", text.alias("written"))
    return written.select("o_orderkey", F.date_format(F.expr(values.parse_date("written")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("fn_slug", """
SELECT page_id, substring(lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 40) AS slug
FROM pages""")
def fn_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", values.slug(F.col("url")).alias("slug"))


@query("fn_allow_substring", """
SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red') AS allowed FROM part""")
def fn_allow_substring(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.allows_part(F.col("p_name"), ["RING", "Red"]).alias("allowed"))


@query("fn_allow_exact", "SELECT p_partkey, lower(p_brand) IN ('brand#2', 'brand#17') AS allowed FROM part")
def fn_allow_exact(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.allows_exact(F.col("p_brand"), ["BRAND#2", "brand#17"]).alias("allowed"))


@query("fn_name_similarity", """
SELECT c_custkey, round(1 - levenshtein(lower(c_name), lower(c_mktsegment)) / greatest(length(c_name), length(c_mktsegment)), 6)
  AS similarity FROM customer""")
def fn_name_similarity(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(values.name_similarity(F.col("c_name"), F.col("c_mktsegment")), 6).alias("similarity"))


@query("ui_color_hex", with_views("elements") + """
, parts AS (SELECT *, regexp_extract_all(rgb, '[0-9]+') AS n FROM elements)
SELECT element, CASE WHEN len(n) >= 3 THEN printf('#%02X%02X%02X', CAST(n[1] AS INT), CAST(n[2] AS INT), CAST(n[3] AS INT))
  ELSE rgb END AS color FROM parts""")
def ui_color_hex(spark, sf):
    return frame(spark, sf, "elements").select("element", values.rgb_to_hex(F.col("rgb")).alias("color"))
