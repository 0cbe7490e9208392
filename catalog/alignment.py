"""Column alignment on customers whose source columns carry other names."""

from pyspark.sql import functions as F

from catalog.registry import frame, query, table, with_views
from twinframe.operators import align, compare, keys, profile, summaries

# Source names of the customer columns.
SOURCE_NAMES = {"c_custkey": "src_custkey", "c_name": "src_full_name", "c_nationkey": "c_nationkey",
                "c_acctbal": "balance", "c_mktsegment": "src_segment"}
# Target names of the customer columns.
TARGET_NAMES = {"c_custkey": "custkey", "c_name": "name", "c_nationkey": "c_nationkey", "c_acctbal": "account_balance",
                "c_mktsegment": "dim_segment"}


def customers(spark, sf):
    df = table(spark, sf, "customer")
    source = df.select(*[F.col(c).alias(n) for c, n in SOURCE_NAMES.items()])
    target = df.select(*[F.col(c).alias(n) for c, n in TARGET_NAMES.items()]).withColumn(
        "dim_segment", F.when(F.col("c_nationkey") == 3, F.lower("dim_segment")).otherwise(F.col("dim_segment")))
    return source, target


def _aligned_counts(spark, sf, rules, key):
    """What was mapped by which rule, and how the mapped columns compare."""
    source, target = customers(spark, sf)
    alignment = align.align_columns(source.columns, target.columns, rules)
    renamed, (key,) = align.apply_alignment(source, alignment, [key])
    counts = compare.mismatch_counts(keys.key_pair(renamed, target, [key], how="inner"))
    report = alignment.report_frame(spark).select("source_column", F.col("target_column").alias("column"), "rule")
    return report.join(counts, "column")


def _counts_sql(rows):
    return " UNION ALL ".join(
        f"SELECT '{s}' AS source_column, '{t}' AS column, '{rule}' AS rule, count(*) AS compared, {bad} AS mismatches "
        f"FROM customer" for s, t, rule, bad in rows)


CHANGED = "count(*) FILTER (c_nationkey = 3 AND c_mktsegment <> lower(c_mktsegment))"
EXPLICIT = {"src_custkey": "custkey", "src_segment": "dim_segment", "src_gone": "name"}


@query("align_explicit", _counts_sql([
    ("src_custkey", "custkey", "explicit", "CAST(0 AS BIGINT)"), ("src_segment", "dim_segment", "explicit", CHANGED),
    ("c_nationkey", "c_nationkey", "exact", "CAST(0 AS BIGINT)")]))
def align_explicit(spark, sf):
    return _aligned_counts(spark, sf, align.AlignmentRules(EXPLICIT), "src_custkey")


@query("align_exact", """
SELECT n_nationkey AS c_nationkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer
ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def align_exact(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "C_NationKey")
    source = align.lower_columns(nation)
    alignment = align.align_columns(source.columns, table(spark, sf, "customer").columns,
                                    align.AlignmentRules(source_prefixes=["n_"]))
    exact = [s for s, t, rule, _ in alignment.report if rule == "exact"]
    counts = table(spark, sf, "customer").groupBy(*exact).agg(F.count("c_custkey").alias("customers"))
    return source.join(counts, exact, "left").select(
        *exact, "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


PREFIXES = dict(source_prefixes=["src_"], target_prefixes=["dim_"])


@query("align_prefix", _counts_sql([
    ("src_custkey", "custkey", "prefix", "CAST(0 AS BIGINT)"), ("src_segment", "dim_segment", "prefix", CHANGED),
    ("c_nationkey", "c_nationkey", "exact", "CAST(0 AS BIGINT)")]))
def align_prefix(spark, sf):
    return _aligned_counts(spark, sf, align.AlignmentRules(**PREFIXES), "src_custkey")


ALL_ALIGNED = [
    ("src_custkey", "custkey", "prefix", "CAST(0 AS BIGINT)"), ("src_segment", "dim_segment", "prefix", CHANGED),
    ("c_nationkey", "c_nationkey", "exact", "CAST(0 AS BIGINT)"), ("balance", "account_balance", "suffix", "CAST(0 AS BIGINT)"),
    ("src_full_name", "name", "suffix", "CAST(0 AS BIGINT)")]


@query("align_suffix", _counts_sql(ALL_ALIGNED))
def align_suffix(spark, sf):
    return _aligned_counts(spark, sf, align.AlignmentRules(by_suffix=True, **PREFIXES), "src_custkey")


@query("align_ambiguity", """
SELECT 'src_name' AS source_column, 'ambiguous' AS rule, count(c_name) AS non_null FROM customer
UNION ALL SELECT 'src_key', 'prefix', count(c_custkey) FROM customer""")
def align_ambiguity(spark, sf):
    source = table(spark, sf, "customer").select(F.col("c_custkey").alias("src_key"), F.col("c_name").alias("src_name"))
    decided = align.align_columns(source.columns, ["key", "first_name", "last_name"],
                                  align.AlignmentRules(source_prefixes=["src_"], by_suffix=True))
    counts = profile.null_and_empty_counts(source).select(
        F.col("column").alias("source_column"), (F.col("row_count") - F.col("null_count")).alias("non_null"))
    return decided.report_frame(spark).select("source_column", "rule").join(counts, "source_column")


@query("align_apply", """
SELECT c_custkey AS custkey, c_name AS name, c_nationkey, c_acctbal AS account_balance, c_mktsegment AS dim_segment
FROM customer""")
def align_apply(spark, sf):
    source, target = customers(spark, sf)
    rules = align.AlignmentRules(by_suffix=True, **PREFIXES)
    return align.apply_alignment(source, align.align_columns(source.columns, target.columns, rules))[0]


@query("column_diff", """
SELECT 'source' AS side, unnest(['src_custkey', 'src_full_name', 'balance', 'src_segment']) AS column,
  (SELECT count(*) FROM customer) AS n_rows
UNION ALL SELECT 'target', unnest(['custkey', 'name', 'account_balance', 'dim_segment']), (SELECT count(*) FROM customer)""")
def column_diff(spark, sf):
    source, target = customers(spark, sf)
    size = lambda df, side: profile.null_and_empty_counts(df).select(
        F.lit(side).alias("side"), "column", F.col("row_count").alias("n_rows"))
    sizes = size(source, "source").unionByName(size(target, "target"))
    return align.column_diff(source, target).join(sizes, ["side", "column"])


@query("normalize_frame", with_views("lines_tgt") + """
SELECT l_orderkey, l_linenumber, l_partkey, trim(l_linestatus) AS l_linestatus, l_returnflag FROM lines_tgt""")
def normalize_frame(spark, sf):
    return align.normalize_frame(frame(spark, sf, "lines_tgt")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")


@query("filter_status", with_views("history") + """
SELECT validation_name, validation, result, pk FROM history WHERE result = 'FAIL' AND validation = 'data_validation'""")
def filter_status(spark, sf):
    failed = summaries.by_status(frame(spark, sf, "history"), "FAIL")
    return summaries.by_validation_type(failed, "data_validation").select("validation_name", "validation", "result", "pk")
