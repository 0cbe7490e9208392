import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import types, values

TEXT, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


@pytest.mark.parametrize("s, t, s_type, t_type, equal", [
    ("123", 123, TEXT, LONG, True), (" 1.0 ", 1, TEXT, LONG, True), ("007", 7, TEXT, LONG, True),
    ("+5", 5, TEXT, LONG, True), ("1.", 1, TEXT, LONG, True), (".5", 0.5, TEXT, DOUBLE, False),
    ("1e5", 100000, TEXT, LONG, False), (True, 1, BOOL, LONG, True), (False, 1, BOOL, LONG, False),
    (None, float("nan"), TEXT, DOUBLE, True), ("", None, TEXT, TEXT, False), ("a ", "a", TEXT, TEXT, True),
    (" x　", "x", TEXT, TEXT, True), ("12.50", "12.5", TEXT, TEXT, True), ("12.50", "12.51", TEXT, TEXT, False),
    ("00123", "000123", TEXT, TEXT, True), ("-0", "0", TEXT, TEXT, True), ("-7", "7", TEXT, TEXT, False),
    ("0.1", "0.10", TEXT, TEXT, True), ("12345678901234567890123", "+12345678901234567890123", TEXT, TEXT, True),
    ("12345678901234567890123", "12345678901234567890124", TEXT, TEXT, False),
    ("5", "5x", TEXT, TEXT, False), ("a\nb", "a\nb\n", TEXT, TEXT, True), ("a\nb", "a\nc", TEXT, TEXT, False),
    (1, 1.0, LONG, DOUBLE, True), (0.0, -0.0, DOUBLE, DOUBLE, True), (float("nan"), None, DOUBLE, DOUBLE, True),
    (2, 2.5, LONG, DOUBLE, False),
])
def test_equality(spark, s, t, s_type, t_type, equal):
    schema = T.StructType([T.StructField("s", s_type), T.StructField("t", t_type)])
    df = spark.createDataFrame([(s, t)], schema)
    both = [F.expr(values.unequal("s", "t", s_type, t_type)), F.expr(values.unequal("t", "s", t_type, s_type))]
    assert list(df.select(*both).first()) == [not equal, not equal]


def test_canon_keys(spark):
    given = ["123", " 1.0 ", "007", "+5", "1.", ".5", "1e5", "", "-0", "12345678901234567890123", "-2.50", None, "000"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string")
    got = [r.k for r in df.select("i", F.expr(values.canon("x", TEXT)).alias("k")).orderBy("i").collect()]
    assert got == ["n:123", "n:1", "n:7", "n:5", "n:1", "s:.5", "s:1e5", "s:", "n:0",
                   "n:12345678901234567890123", "n:-2.5", None, "n:0"]


def test_timestamp_differs_from_its_text(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2), "2024-01-02 00:00:00")], "s timestamp, t string")
    assert df.select(F.expr(values.unequal("s", "t", T.TimestampType(), TEXT))).first()[0]


@pytest.mark.parametrize("s, t, hit", [
    ("07", "7", True), ("007", "7", False), ("010", "10", False), ("0", "", True), ("7", "07", True), ("7", "8", False)])
def test_leading_zero(spark, s, t, hit):
    df = spark.createDataFrame([(s, t)], "s string, t string")
    assert df.select(F.expr(values.differs_in_leading_zero("s", "t"))).first()[0] is hit


@pytest.mark.parametrize("rule, s, t, hit", [
    (values.differs_in_case, "Alice", "ALICE", True), (values.differs_in_case, "Alice", "Bob", False),
    (values.differs_in_ascii, "note", "nöte", True), (values.differs_in_ascii, "nöte", "nöté", False)])
def test_text_rules(spark, rule, s, t, hit):
    df = spark.createDataFrame([(s, t)], "s string, t string")
    assert df.select(F.expr(rule("s", "t"))).first()[0] is hit


def test_formatting(spark):
    df = spark.createDataFrame([(123, "abc", "x" * 101)], "id long, code string, long string")
    key = F.expr(values.format_key([("id", "id", LONG), ("code", "code", TEXT)]))
    r = df.select(key.alias("key"), F.expr(values.truncate("long")).alias("cut"),
                  F.expr(values.safe_repr("code", TEXT)).alias("shown"),
                  values.slug(F.lit("  Sales / Région 2024!")).alias("slug"),
                  values.rgb_to_hex(F.lit("rgb(255,0,0)")).alias("hex"),
                  values.allows_part(F.lit("Arial, sans-serif"), ["ARIAL"]).alias("part"),
                  values.allows_exact(F.lit("12px"), ["12PX"]).alias("exact")).first()
    assert r.key == "id=123, code='abc'"
    assert r.cut == "x" * 97 + "..."
    assert (r.shown, r.slug, r.hex, r.part, r.exact) == ("'abc'", "sales_région_2024", "#FF0000", True, True)


def test_dates_from_text(spark):
    given = {"2024-01-02": True, "1999": True, "123": False, "0899": True, "9999-12-31": True, "01/02/2024": False, "": False}
    df = spark.createDataFrame([(g,) for g in given], "x string")
    date = lambda **how: F.expr(values.parse_date("x", **how)).isNotNull()
    assert {r.x: r.ok for r in df.select("x", date().alias("ok")).collect()} == given
    bounded = {r.x: r.ok for r in df.select("x", date(bounded=True).alias("ok")).collect()}
    assert bounded == {**given, "0899": False, "9999-12-31": False}


def test_hash_algorithms(spark):
    df = spark.createDataFrame([("a", None)], "a string, b double")
    cells = [("a", TEXT), ("b", DOUBLE)]
    r = df.select(F.expr(values.row_hash(cells)), F.expr(values.row_hash(cells, "sha256")), F.md5(F.lit("a|nan")), F.sha2(F.lit("a|nan"), 256)).first()
    assert r[0] == r[2] and r[1] == r[3]
    with pytest.raises(ValueError):
        values.row_hash(cells, "crc")


def test_type_rules():
    assert types.compatible(T.IntegerType(), T.DecimalType(10, 2))
    assert types.compatible(T.DateType(), T.TimestampNTZType())
    assert not types.compatible(T.StringType(), T.LongType())
    assert types.is_type(T.ShortType(), "integer") and types.is_type(T.FloatType(), "double")
    assert not types.is_type(T.StringType(), "int")
