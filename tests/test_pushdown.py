import datetime
from decimal import Decimal

import pytest

from twinframe.operators import bloom, pushdown
from twinframe.operators.pushdown import keep_pushed_keys
from twinframe.shared import written


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["list", "filter", "filter too small"])
def side(request, monkeypatch):
    """Which way of the IN_LIST line keys go."""
    if request.param != "list":
        monkeypatch.setattr(pushdown, "IN_LIST", 0)
    if request.param == "filter too small":
        monkeypatch.setattr(bloom, "WORDS", 1)
        monkeypatch.setattr(bloom, "BITS", 1 << 20)


nan = float("nan")
CASES = {
    "text": ("string", ["a", "B", " a", "", "é", None, "a'b"], ["a", "", "a'b", "none", "a"]),
    "text and null": ("string", ["a", "", None, None, "b"], ["", None]),
    "null only": ("int", [1, None, 3], [None]),
    "integers": ("bigint", [1, -5, 2 ** 62, None, 7], [2 ** 62, -5, 8]),
    "small": ("tinyint", [1, -5, None, 7], [7, -5, 8]),
    "doubles": ("double", [1.5, nan, None, 0.0, -0.0, float("inf")], [nan, -0.0, float("inf")]),
    "floats": ("float", [1.5, nan, None, 0.1, 0.25], [0.1, 1.5, 0.75]),
    "decimals": ("decimal(20,4)", [Decimal("1.5000"), Decimal("-7777777777777777.0001"), None], [Decimal("1.5"), Decimal("-7777777777777777.0001")]),
    "dates": ("date", [datetime.date(2020, 1, 1), datetime.date(1, 1, 1), None], [datetime.date(1, 1, 1), datetime.date(2021, 1, 1)]),
    "times": ("timestamp", [datetime.datetime(2020, 10, 25, 1, 30, 0, 7), datetime.datetime(1950, 1, 1), None], [datetime.datetime(2020, 10, 25, 1, 30, 0, 7)]),
    "bytes": ("binary", [b"a", b"", None], [b"", b"zz"]),
    "flags": ("boolean", [True, False, None], [False]),
    "none": ("int", [1, 2, None], []),
}


def same(a, b):
    return (a is None or a != a) and (b is None or b != b) or a == b


@pytest.mark.parametrize("case", CASES)
def test_equal_rows_on_both_sides_of_the_line(spark, rows, side, case):
    kind, values, wanted = CASES[case]
    target = spark.createDataFrame(list(enumerate(values)), f"n int, `the key` {kind}")
    keys = spark.createDataFrame([(w,) for w in wanted], f"k {kind}")
    got = keep_pushed_keys(target, keys, ["k"], ["the key"])
    assert got.columns == target.columns
    rounded = [r["k"] for r in keys.collect()]  # a float's value as Spark holds it
    held = [r["the key"] for r in target.orderBy("n").collect()]
    assert sorted(r.n for r in got.collect()) == [i for i, v in enumerate(held) if any(same(v, w) for w in rounded)]


def test_two_keys(spark, rows, side):
    data = [(a, b, i) for i, (a, b) in enumerate((a, b) for a in (1, 2, None) for b in ("x", "", None) for _ in range(2))]
    target = spark.createDataFrame(data, "a int, b string, n int")
    wanted = [(1, "x"), (1, "x"), (2, None), (None, ""), (5, "x")]
    got = keep_pushed_keys(target, spark.createDataFrame(wanted, "a int, b string"), ["a", "b"])
    assert rows(got) == sorted([r for r in data if r[:2] in wanted], key=repr)


def test_different_types_meet_by_value(spark, rows, side):
    target = spark.createDataFrame([(i, i * i) for i in range(20)], "id int, v int")
    text = spark.createDataFrame([("3",), ("x",), ("5.0",)], "key string")
    assert rows(keep_pushed_keys(target, text, ["key"], ["id"])) == [(3, 9), (5, 25)]
    assert rows(keep_pushed_keys(target, text, ["key"], ["id"], "strict")) == []


def test_filter_lets_no_key_down_and_few_others_pass(spark):
    keys = spark.range(0, 200_000, 2)
    bits, words = bloom.bloom_filter(keys.toDF("__k0"), ["__k0"], 100_000)
    assert words * 64 >= 100_000 * bloom.BITS and bits.count() <= words
    from pyspark.sql import functions as F
    at, mask = bloom.key_bits(["__k0"], words)
    tested = spark.range(0, 200_000).toDF("__k0").withColumn("w", at).withColumn("m", mask).join(
        F.broadcast(bits), (F.col("w") == F.col("__word")) & (F.col("m").bitwiseAND(F.col("__bits")) == F.col("m")), "left_semi")
    found = tested.groupBy(F.expr("__k0 % 2").alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in found}
    assert n[0] == 100_000 and n[1] < 5_000


@pytest.fixture
def lines(spark):
    rows = [(i // 3, i % 3, f"t{i}", float(i)) for i in range(6_000)]
    return written(spark.createDataFrame(rows, "o int, l int, t string, v double"))


def test_few_keys_reach_the_scan(spark, lines):
    one = plan(keep_pushed_keys(lines, lines.where("o < 5").select("o"), ["o"]))
    assert "PushedFilters: [In(o" in one and "Join" not in one and "Exchange" not in one
    two = plan(keep_pushed_keys(lines, lines.where("o < 5 and l < 2").select("o", "l"), ["o", "l"]))
    assert "In(o" in two.split("PushedFilters")[1] and "In(l" in two.split("PushedFilters")[1]
    assert "BroadcastHashJoin" in two and "SortMergeJoin" not in two


def test_many_keys_are_tested_before_the_shuffle(spark, lines):
    for wanted, keys in ((lines.where("o % 2 = 0 and o < 2000 and o > 99").select("o", "l"), ["o", "l"]),
                         (lines.where("v > 4000").select("t"), ["t"])):
        kept = keep_pushed_keys(lines, wanted, keys)
        text = plan(kept)
        assert f"GreaterThanOrEqual({keys[0]}" in text and f"LessThanOrEqual({keys[-1]}" in text
        assert kept.count() == wanted.count()
        # what the filter is tested on comes from the scan itself
        first = text[text.index("__mask"):]
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning(__mask" not in first


def test_clashing_names(spark, rows, side):
    target = spark.createDataFrame([(1, 2, 3, 4), (5, 6, 7, 8)], "word int, mask int, bits int, `a.b` int")
    assert rows(keep_pushed_keys(target, target.where("word = 5"), ["a.b"])) == [(5, 6, 7, 8)]
