import pytest

from twinframe.operators import expectations as ex

SCHEMA = "id int, s string, v double, flag boolean, d date"
DATA = "SELECT * FROM VALUES (1, 'ab', 1.0D, true, DATE'2024-01-01'), (2, 'xab', 5.0D, false, DATE'2024-02-01'), " \
       "(3, NULL, CAST('NaN' AS DOUBLE), NULL, NULL), (3, '1', NULL, true, DATE'2023-01-01') AS t(id, s, v, flag, d)"


def outcome(spark, **rule):
    r = ex.check_expectations(spark.sql(DATA), [rule]).collect()
    return (r[0].result, r[0].violations) if r else None


@pytest.mark.parametrize("rule, expected", [
    (dict(type=ex.NOT_NULL, column="s"), ("FAIL", 1)),
    (dict(type=ex.NOT_NULL, column="v"), ("FAIL", 2)),
    (dict(type=ex.NOT_NULL, column="id"), ("PASS", 0)),
    (dict(type=ex.UNIQUE, column="id"), ("FAIL", 1)),
    (dict(type=ex.UNIQUE, column="s"), ("FAIL", 1)),
    (dict(type=ex.BETWEEN, column="v", min_value=2, max_value=None), ("FAIL", 1)),
    (dict(type=ex.BETWEEN, column="v", min_value=None, max_value=5), ("PASS", 0)),
    (dict(type=ex.BETWEEN, column="d", min_value="2024-01-01", max_value="2024-01-31"), ("FAIL", 2)),
    (dict(type=ex.BETWEEN, column="s", min_value=1, max_value=2), ("ERROR", None)),
    (dict(type=ex.BETWEEN, column="v", min_value="1", max_value=2), ("ERROR", None)),
    (dict(type=ex.REGEX, column="s", regex="a"), ("FAIL", 3)),
    (dict(type=ex.REGEX, column="s", regex="a|x|1|nan"), ("PASS", 0)),
    (dict(type=ex.REGEX, column="s"), ("ERROR", None)),
    (dict(type=ex.IN_SET, column="s", value_set=["ab", "xab", 1]), ("FAIL", 1)),
    (dict(type=ex.IN_SET, column="id", value_set=["1", 2, 3]), ("FAIL", 1)),
    (dict(type=ex.IN_SET, column="id", value_set=[True, 2, 3]), ("PASS", 0)),
    (dict(type=ex.IN_SET, column="flag", value_set=[1]), ("FAIL", 1)),
    (dict(type=ex.EXISTS, column="gone"), ("FAIL", 1)),
    (dict(type=ex.NOT_NULL, column="gone"), ("FAIL", None)),
    (dict(type=ex.NOT_NULL), ("ERROR", None)),
    (dict(type=ex.ROW_COUNT, min_value=4, max_value=None), ("PASS", 0)),
    (dict(type=ex.ROW_COUNT, max_value=3), ("FAIL", 1)),
    (dict(type=ex.OF_TYPE, column="id", type_name="int64"), ("PASS", 0)),
    (dict(type=ex.OF_TYPE, column="v", type_name="int"), ("FAIL", 1)),
    (dict(type="expect_something_else", column="v"), None),
])
def test_rules(spark, rule, expected):
    assert outcome(spark, **rule) == expected


def test_texts(spark):
    df = spark.sql(DATA)
    r = ex.check_expectations(df, [dict(type=ex.BETWEEN, column="v", min_value=2, max_value=9),
                                   dict(type=ex.UNIQUE, column="id")]).orderBy("rule").collect()
    assert r[0].target_value == "min=2,max=9,violations=1" and "1 value(s) outside [2, 9]" in r[0].detail
    assert r[1].target_value == "unique=3,total=4" and r[1].detail == "Column 'id': 1 duplicate(s)"


def test_empty_frame(spark):
    df = spark.sql(DATA).limit(0)
    r = ex.check_expectations(df, [dict(type=ex.UNIQUE, column="id"), dict(type=ex.NOT_NULL, column="s")]).collect()
    assert [x.result for x in r] == ["PASS", "PASS"]
    assert ex.check_expectations(df, []).count() == 0


def test_violating_rows(spark):
    df = spark.sql(DATA)
    ids = lambda rule: sorted(r.id for r in ex.violating_rows(df, rule).collect())
    assert ids(dict(type=ex.UNIQUE, column="id")) == [3, 3]
    assert ids(dict(type=ex.UNIQUE, column="s")) == [3]
    assert ids(dict(type=ex.BETWEEN, column="v", min_value=2, max_value=9)) == [1]


def test_run_on(spark):
    df = spark.sql(DATA)
    rules = [dict(type=ex.NOT_NULL, column="id")]
    sides = lambda on: sorted(r.side for r in ex.run_expectations(df, df, rules, on).collect())
    assert (sides("both"), sides("source"), sides("target")) == (["source", "target"], ["source"], ["target"])
