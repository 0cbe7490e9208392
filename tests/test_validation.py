import os

import pytest
from pyspark.sql import functions as F

from twinframe.model import RESULT_FIELDS
from twinframe.plans import validation as runs
from twinframe.plans.suite import (
    load_config, load_dataset, options_from, run_count_check, run_suite, summary_frame)
from twinframe.plans.validation import Options, validate

SCHEMA = "id int, name string, amount double, day string"
DATA = [(i, f"name{i}", i * 1.5, f"2024-01-{i % 28 + 1:02d}") for i in range(30)]


def source(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def found(outcome, validation, result=None):
    return [r for r in outcome.rows if r[0] == validation and result in (None, r[1])]


def test_equal_data_passes(spark):
    df = source(spark)
    out = validate(df, df.repartition(3), "id", Options(regression=True))
    assert out.status == "PASS" and out.count("FAIL") == 0 and not out.subset_applied
    names = [r[0] for r in out.rows]
    assert names[:2] == ["record_count_check", "column_count_check"]
    for name in ("duplicate_check", "null_check", "empty_string_check", "primary_key_match", "data_validation",
                 "column_order_check", "column_specs_check", "distinct_value_check", "date_range_check",
                 "case_sensitivity_check", "leading_zero_check", "special_char_check", "checksum_check",
                 "symmetric_difference_check"):
        assert name in names
    assert out.results.columns == RESULT_FIELDS


def test_differences_are_reported(spark):
    df = source(spark)
    t = (df.withColumn("name", F.when(F.col("id") == 3, F.upper("name")).when(F.col("id") == 4, F.lit("")).otherwise(F.col("name")))
         .withColumn("amount", F.when(F.col("id") == 5, None).otherwise(F.col("amount")))
         .withColumn("id", F.when(F.col("id") == 9, 99).otherwise(F.col("id"))))
    t = t.union(t.where("id = 7"))
    out = validate(df, t, "id", Options(regression=True))
    # The source is smaller: the target is cut to its keys.
    assert out.subset_applied
    assert found(out, "record_count_check")[0][5:] == ("30", "30")
    assert [r[3] for r in found(out, "duplicate_check", "FAIL")] == ["id=7"]
    assert found(out, "primary_key_match")[0][4] == "Common: 29, Source-only: 1, Target-only: 0"
    assert found(out, "primary_key_match")[1][3] == "id=9"
    assert [(r[2], r[3]) for r in found(out, "data_validation", "FAIL")] == [
        ("amount", ""), ("amount", "id=5"), ("name", ""), ("name", "id=3"), ("name", "id=4")]
    assert [r[5:] for r in found(out, "data_validation")][1] == ("7.5", "nan")
    assert found(out, "null_check", "FAIL")[0][2] == "amount"
    assert found(out, "empty_string_check", "FAIL")[0][3] == "id=4"
    assert found(out, "case_sensitivity_check", "FAIL")[0][3] == "id=3"
    assert len(found(out, "checksum_check", "FAIL")) == 3
    assert out.status == "FAIL"


def test_no_common_keys_compares_everything(spark):
    df = source(spark)
    out = validate(df, df.withColumn("id", F.col("id") + 100).limit(20), "id")
    assert not out.subset_applied
    assert found(out, "primary_key_match")[0][4] == "Common: 0, Source-only: 30, Target-only: 20"


def test_missing_key_column(spark):
    df = source(spark)
    out = validate(df, df, "nope")
    assert found(out, "duplicate_check")[0][1] == "SKIP"
    assert found(out, "data_validation")[0][1] == "FAIL"


def test_without_key(spark):
    df = source(spark)
    assert found(validate(df, df.orderBy(F.desc("id")), []), "data_validation")[0][1] == "PASS"
    t = df.withColumn("name", F.when(F.col("id") == 0, F.lit("x")).otherwise(F.col("name")))
    out = validate(df, t, "")
    assert [r[2] for r in found(out, "data_validation", "FAIL")] == ["name"]


def test_alignment_and_mixed_types(spark):
    s = source(spark).select(F.col("id").cast("string").alias("SRC_ID"), F.col("amount").cast("string").alias("src_amount"))
    t = source(spark).select("id", "amount")
    config = {"source_prefixes_to_strip": ["src_"], "regression": True}
    out = validate(s, t, "src_id", options_from(config))
    assert found(out, "primary_key_match")[0][1] == "PASS" and found(out, "data_validation")[0][1] == "PASS"
    assert {r[2]: r[1] for r in found(out, "metadata_type_check")} == {"amount": "FAIL", "id": "FAIL"}


def test_key_sampling(spark):
    df = source(spark)
    out = validate(df, df, "id", Options(sample_keys=7))
    assert found(out, "record_count_check")[0][5:] == ("7", "7") and out.subset_applied and out.status == "PASS"
    all_keys = validate(df.where("id < 5"), df, "id", Options(filter_target=True))
    assert found(all_keys, "record_count_check")[0][5:] == ("5", "5")


def test_rules_and_outliers_are_part_of_the_run(spark):
    df = source(spark).withColumn("amount", F.when(F.col("id") == 1, 1e6).otherwise(F.col("amount")))
    options = Options(
        expectations=[{"type": "expect_column_values_to_not_be_null", "column": "name"}], expectations_on="source",
        anomaly={"columns": ["amount", "name"], "contamination": 0.05, "run_on": "target"})
    out = validate(df, df, "id", options)
    assert [r[1] for r in found(out, "expectation")] == ["PASS"]
    assert found(out, "anomaly_detection")[0][1] == "WARN" and found(out, "anomaly_detection_detail")[0][1] == "INFO"
    assert 1 in {r.id for r in out.anomalies["target"].where("is_anomaly").collect()}
    assert [r.id for r in out.top_anomalies("target", 1).collect()] == [1]
    bad = validate(df, df, "id", Options(anomaly={"columns": ["name"]}))
    assert [r[1] for r in found(bad, "anomaly_detection")] == ["ERROR", "ERROR"]


def test_strict_columns(spark):
    df = source(spark)
    assert found(validate(df, df.drop("day"), "id"), "column_count_check")[0][1] == "PASS"
    assert found(validate(df, df.drop("day"), "id", Options(strict_columns=True)), "column_count_check")[0][1] == "FAIL"


def test_suite_from_configuration(spark, tmp_path):
    df = source(spark)
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    df.withColumn("amount", F.col("amount") + (F.col("id") == 2).cast("int")).createOrReplaceTempView("suite_rows")
    text = f"""
validations:
  - name: Files and table
    primary_keys: [id]
    format: csv
    source: {{type: file, path: {tmp_path}/in}}
    target: {{type: table, table: suite_rows}}
  - name: Query
    primary_keys: id
    source: {{type: table, table: suite_rows, where: WHERE id < 10}}
    target: {{type: table, query: SELECT * FROM suite_rows WHERE id < 10}}
"""
    path = tmp_path / "suite.yaml"
    path.write_text(text)
    outcomes, results = run_suite(spark, load_config(path), output_dir=str(tmp_path / "out"))
    assert [(o.name, o.status) for o in outcomes] == [("Files and table", "FAIL"), ("Query", "PASS")]
    assert [r[3] for r in found(outcomes[0], "data_validation", "FAIL")] == ["", "id='2'"]
    assert results.columns == ["validation_name", *RESULT_FIELDS]
    assert len(list((tmp_path / "out").iterdir())) == 3
    assert {r.validation_name: r.status for r in summary_frame(spark, outcomes).collect()} == {
        "Files and table": "FAIL", "Query": "PASS"}
    assert len(run_suite(spark, load_config(path), only="Query", sample=3)[0]) == 1
    assert found(run_suite(spark, load_config(path), only="Query", target_limit=4)[0][0], "record_count_check")[0][5:] == ("4", "4")
    with pytest.raises(ValueError):
        run_suite(spark, load_config(path), only="Nope")


def test_configured_rules_can_be_switched_off():
    rules = [{"type": "expect_column_to_exist", "column": "A.b"}]
    on = options_from({"great_expectations": {"run_on": "source", "expectations": rules},
                       "anomaly_detection": {"columns": ["x"]}})
    assert on.expectations[0]["column"] == "a_b" and on.expectations_on == "source" and on.anomaly
    off = options_from({"great_expectations": {"enabled": False, "expectations": rules},
                        "anomaly_detection": {"enabled": False, "columns": ["x"]}})
    assert off.expectations == [] and off.anomaly == {}
    assert options_from({"expectations": rules}).expectations_on == "both"


def test_count_check_from_configuration(spark, tmp_path):
    source(spark).write.parquet(str(tmp_path / "p.parquet"))
    source(spark).createOrReplaceTempView("counted")
    file, table = {"type": "file", "path": str(tmp_path / "p.parquet")}, {"type": "table", "table": "counted"}
    gone = {"type": "file", "path": str(tmp_path / "none.parquet")}
    short = {"type": "table", "query": "SELECT id FROM counted WHERE id < 3", "table": "few"}
    config = {"validations": [
        {"name": "same", "source": file, "target": table}, {"source": gone, "target": table},
        {"name": "no table", "source": file, "target": {"type": "table", "table": "not_there"}},
        {"name": "short", "source": file, "target": short}]}
    r = {x.name: x for x in run_count_check(spark, config).collect()}
    assert (r["same"].csv_rows, r["same"].table_rows, r["same"].rows_match, r["same"].status) == ("30", "30", "YES", "PASSED")
    assert (r["validation_2"].csv_rows, r["validation_2"].table_rows, r["validation_2"].status) == ("ERROR", "N/A", "FAILED")
    assert (r["no table"].csv_rows, r["no table"].table_rows, r["no table"].rows_match) == ("30", "ERROR", "ERROR")
    assert (r["short"].table_rows, r["short"].table_cols, r["short"].rows_match, r["short"].cols_match) == ("3", "1", "NO", "NO")


def test_bad_configuration(spark):
    with pytest.raises(ValueError):
        load_dataset(spark, {"type": "cloud"})
    for n in (0, "x", -3):
        with pytest.raises(ValueError):
            options_from({"quick_sample_pks": n})


def _counted(monkeypatch, *names):
    calls = []
    for n in names:
        real = getattr(runs, n)
        monkeypatch.setattr(runs, n, lambda *a, n=n, real=real, **k: calls.append(n) or real(*a, **k))
    return calls


@pytest.mark.parametrize("extra,joins", [([], ["key_pair"]), ([(1, "a"), (1, "b"), (2, "")], ["key_pair", "keep_key_columns"])])
def test_one_join_cuts_and_compares(spark, monkeypatch, extra, joins):
    source = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    target = spark.createDataFrame([(i, f"v{i}" if i % 5 else None) for i in range(50)] + extra, "k int, v string")
    calls = _counted(monkeypatch, "key_pair", "keep_keys", "keep_key_columns")
    out = validate(source, target, "k", Options(regression=True))
    assert calls == joins and out.subset_applied
    found = {(r[0], r[2]): r for r in out.rows if not r[3]}
    assert found["record_count_check", ""][5:] == ("20", str(20 + len(extra)))
    assert found["null_check", "v"][5:] == ("0", "4")
    assert found["data_validation", "v"][4] == f"{6 if extra else 4} mismatches in column v"
    assert [r[3] for r in out.rows if r[0] == "empty_string_check" and r[1] == "FAIL"] == (["k=2"] if extra else [])
    folder = spark.conf.get("spark.checkpoint.dir")
    assert not [f for f in os.listdir(folder) if f.startswith(("joined-", "subset-"))]


def test_cut_keeps_nested_columns(spark):
    source = spark.createDataFrame([(i, [i]) for i in range(5)], "k int, v array<int>")
    target = spark.createDataFrame([(i, [i] if i % 2 else [0, i]) for i in range(9)], "k int, v array<int>")
    out = validate(source, target, "k", Options())
    found = {(r[0], r[2]): r for r in out.rows if not r[3]}
    assert found["record_count_check", ""][5:] == ("5", "5") and found["metadata_type_check", "v"][5:] == ("array<int>", "array<int>")
    assert found["data_validation", "v"][4] == "3 mismatches in column v"


def test_no_common_key_compares_everything(spark):
    source = spark.createDataFrame([(i, "a") for i in range(5)], "k int, v string")
    target = spark.createDataFrame([(100 + i, "a") for i in range(9)], "k int, v string")
    out = validate(source, target, "k", Options())
    found = {(r[0], r[2]): r for r in out.rows if not r[3]}
    assert not out.subset_applied and found["record_count_check", ""][5:] == ("5", "9")
    assert found["primary_key_match", ""][4] == "Common: 0, Source-only: 5, Target-only: 9"


def test_flagged_rows_of_a_cut_side_can_be_read_later(spark):
    source = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "k int, x double")
    target = spark.createDataFrame([(i, float(i % 7) if i != 30 else 900.0) for i in range(99)], "k int, x double")
    out = validate(source, target, "k", Options(anomaly={"columns": ["x"], "run_on": "target", "max_samples": 0.5, "n_estimators": 20}))
    assert [r.k for r in out.top_anomalies("target", 1).collect()] == [30]
    bad = validate(source, target, "k", Options(anomaly={"columns": ["x"], "run_on": "target", "max_samples": 1.5}))
    assert [r[1] for r in bad.rows if r[0] == "anomaly_detection"] == ["ERROR"]


def test_a_pushed_side_is_cut_once(spark, monkeypatch):
    """The checks read the cut side as written, and its files go; nested columns are cut anew."""
    from twinframe.plans import validation
    labels, whole = [], validation.stored
    monkeypatch.setattr(validation, "stored", lambda df, folders, label: (labels.append((label, df.columns)), whole(df, folders, label))[1])
    df = spark.createDataFrame([(i, f"v{i}") for i in range(30)], "id int, v string")
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    out = validate(df.where("id < 9"), df, "id", Options(filter_target=True))
    assert labels[0] == ("subset", ["id", "v"]) and out.subset_applied
    assert [r[5:] for r in out.rows if r[0] == "record_count_check"] == [("9", "9")]
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert not [f for f in left if f.startswith("subset-")]
    labels.clear()
    nested = df.selectExpr("id", "array(v) AS v")
    assert validate(nested.where("id < 9"), nested, "id", Options(filter_target=True)).status == "PASS"
    assert ("subset", ["id", "v"]) not in labels
