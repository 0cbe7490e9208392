"""Aggregates over check results.

The input has the result fields plus `validation_name` (the run a row belongs
to) and, where the first row matters, `ordinal` (its place in the run).
"""

from functools import reduce

from pyspark.sql import functions as F


def by_status(results, status):
    return results.where(F.col("result") == status)


def by_validation_type(results, validation):
    return results.where(F.col("validation") == validation)


def _count(status):
    return F.count_if(F.col("result") == status)


def status_counts(results):
    """Pass, fail, skip and total rows; overall PASS unless a row failed."""
    return results.agg(
        _count("PASS").alias("pass_count"), _count("FAIL").alias("fail_count"), _count("SKIP").alias("skip_count"),
        F.count(F.lit(1)).alias("total_count")).withColumn("overall", _verdict(F.col("fail_count")))


def _verdict(failed):
    return F.when(failed == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))


def counts_by_validation(results):
    return results.groupBy("validation").agg(_count("PASS").alias("passes"), _count("FAIL").alias("fails"))


def top_failing_columns(results, n=20):
    """The columns with most failing rows."""
    return (by_status(results, "FAIL").where(F.col("column") != "").groupBy("column")
            .agg(F.count(F.lit(1)).alias("fails")).orderBy(F.desc("fails"), "column").limit(n))


def failure_summary(results):
    """Failing rows per validation and the first failing detail, 120 characters at most."""
    first = F.min(F.struct("ordinal", "column", "detail"))
    detail = F.col("first.detail")
    short = F.when(F.length(detail) > 120, F.concat(F.substring(detail, 1, 120), F.lit("…"))).otherwise(detail)
    return (by_status(results, "FAIL").groupBy("validation")
            .agg(F.count(F.lit(1)).alias("fails"), first.alias("first"))
            .select("validation", "fails", F.col("first.column").alias("column"), short.alias("first_detail")))


def failure_patterns(results, width=None):
    """How often each (source value, target value) pair fails, without outer quotes.

    `width` groups by that many leading characters; whole values by default.
    """
    def short(c):
        bare = F.regexp_replace(c, "^'+|'+$", "")
        return F.substring(bare, 1, width) if width else bare
    return (by_status(results, "FAIL")
            .groupBy(short("source_value").alias("source_value"), short("target_value").alias("target_value"))
            .agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "source_value", "target_value"))


def row_counts(results):
    """Source and target row counts of every run, from its first record count row."""
    first = F.min(F.struct("ordinal", "source_value", "target_value")).alias("f")
    return (by_validation_type(results, "record_count_check").groupBy("validation_name").agg(first)
            .select("validation_name", F.col("f.source_value").alias("source_rows"),
                    F.col("f.target_value").alias("target_rows")))


def suite_summary(results):
    """Status, passed, failed and total rows of every run."""
    return (results.groupBy("validation_name")
            .agg(_count("PASS").alias("passed"), _count("FAIL").alias("failed"), F.count(F.lit(1)).alias("total"))
            .withColumn("status", _verdict(F.col("failed"))))


def run_summary(summary):
    """Passed, failed and total runs, from `suite_summary`."""
    return summary.agg(F.count_if(F.col("status") == "PASS").alias("passed"),
                       F.count_if(F.col("status") == "FAIL").alias("failed"), F.count(F.lit(1)).alias("total"))


def consolidate(named_results):
    """[(run name, results)] stacked with the run name in front."""
    frames = [df.select(F.lit(name).alias("validation_name"), "*") for name, df in named_results]
    return reduce(lambda a, b: a.unionByName(b), frames)
