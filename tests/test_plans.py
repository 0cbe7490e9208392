"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from twinframe.operators import compare, expectations, keys, profile


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    out = []
    for name in ("s", "t"):
        path = str(tmp_path_factory.mktemp(name) / "p")
        spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.col("id").cast("string").alias("a"),
                                (F.col("id") * 1.5).alias("b"), F.lit("unused").alias("z")).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


@pytest.fixture
def plan(spark):
    """Physical plan text without broadcast joins, as for large inputs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_value_comparison_is_one_join_and_two_shuffles(sides, plan):
    text = plan(compare.mismatch_counts(keys.key_pair(*sides, ["id"], how="inner")))
    assert text.count("Join") == 1 and "SortMergeJoin" in text
    # One shuffle per side for grouping, reused by the join, and the final single row.
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Exchange SinglePartition") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_rows_are_combined_before_the_shuffle(sides, plan):
    text = plan(keys.first_per_key(sides[0], ["g"]))
    # rows are shuffled once, by their key; the other exchanges are of the filter's words
    assert "partial_min" in text and text.count("Exchange hashpartitioning(__k0") == 1
    assert text.count("Exchange") - text.count("BroadcastExchange") - text.count("Exchange hashpartitioning(__word") == 1


def test_unique_rows_are_not_sorted_or_shuffled(sides, plan):
    text = plan(keys.first_per_key(sides[0], ["id"]))
    assert "Exchange" not in text and "Sort" not in text


def test_examples_are_limited_before_the_shuffle(sides, plan):
    pair = keys.key_pair(*sides, ["id"], how="inner")
    text = plan(compare.mismatch_examples(pair))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "SinglePartition" not in text


def test_rules_share_one_scan(sides, plan):
    rules = [{"type": expectations.NOT_NULL, "column": "a"}, {"type": expectations.ROW_COUNT, "min_value": 1},
             {"type": expectations.BETWEEN, "column": "b", "min_value": 0, "max_value": 10}]
    text = plan(expectations.check_expectations(sides[0], rules))
    assert text.count("FileScan") == 1 and "unused" not in text
    assert "ReadSchema: struct<a:string,b:double>" in text


def test_profiles_are_one_scan_each(sides, plan):
    text = plan(profile.null_check(*sides, ["a", "b"]))
    assert text.count("FileScan") == 2


def test_distinct_counts_carry_one_value_per_row(sides, plan):
    text = plan(profile.distinct_counts(sides[0], ["a", "b", "id"]))
    assert "Expand" not in text and text.count("FileScan") == 1


def test_predicates_reach_the_scan(sides, plan):
    text = plan(sides[0].where("b > 10").select("id"))
    assert "PushedFilters: [IsNotNull(b), GreaterThan(b,10.0)]" in text


def test_positional_comparison_forms_no_pairs(sides, plan, spark):
    text = plan(compare.positional_segments(*sides, ["a", "g"]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SinglePartition" not in text
