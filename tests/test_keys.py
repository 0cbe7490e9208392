import pytest
from pyspark.sql import functions as F

from twinframe.operators import bloom, keys


def frame(spark, data, schema="k int, v string"):
    return spark.createDataFrame(data, schema)


def test_null_keys_meet(spark, rows):
    a = frame(spark, [(None, "x"), (1, "y")])
    b = frame(spark, [(None, "z"), (2, "y")])
    assert tuple(keys.key_match(keys.key_sets(a, b, ["k"])).first()) == (1, 1, 1)
    assert rows(keys.keep_keys(a, b, ["k"])) == [(None, "x")]
    assert rows(keys.missing_keys(a, b, ["k"])) == [(1,)]
    pair = keys.key_pair(a, b, ["k"], how="inner")
    assert [(r.s.k, r.s.v, r.t.v) for r in pair.frame.collect()] == [(None, "x", "z")]


def test_composite_key_with_null_part(spark):
    schema = "a int, b string, v int"
    s = frame(spark, [(1, None, 1), (1, "x", 2)], schema)
    t = frame(spark, [(1, None, 1), (1, "y", 2)], schema)
    assert tuple(keys.key_match(keys.key_sets(s, t, ["a", "b"])).first()) == (1, 1, 1)


def test_text_and_number_keys(spark):
    s = frame(spark, [("1", "a"), ("x", "b"), ("07", "c")], "k string, v string")
    t = frame(spark, [(1, "a"), (7, "b")])
    assert tuple(keys.key_match(keys.key_sets(s, t, ["k"])).first()) == (2, 1, 0)
    assert tuple(keys.key_match(keys.key_sets(s, t, ["k"], "strict")).first()) == (0, 3, 2)


def test_first_per_key_is_the_smallest_row(spark, rows):
    data = [(1, "b"), (1, "a"), (2, None), (2, "z"), (None, "q"), (None, "p")]
    for parts in (1, 5):
        assert rows(keys.first_per_key(frame(spark, data).repartition(parts), ["k"])) == sorted(
            [(1, "a"), (2, None), (None, "p")], key=repr)


@pytest.mark.parametrize("words", [1 << 19, 1])
def test_unique_rows_bypass_the_reduction(spark, rows, monkeypatch, words):
    monkeypatch.setattr(bloom, "WORDS", words)
    data = [(i, f"v{i % 13}") for i in range(3000)] + [(i * 2, f"u{i}") for i in range(500)] * 2 + [(None, "x"), (None, "a"), (-1, None)]
    first = {}
    for k, v in data:
        if k not in first or v is None or first[k] is not None and v < first[k]:
            first[k] = v
    assert rows(keys.first_per_key(frame(spark, data).repartition(4), ["k"])) == sorted(first.items(), key=repr)
    unique = frame(spark, [(i, "a") for i in range(50)] + [(None, "b")])
    assert rows(keys.first_per_key(unique, ["k"])) == rows(unique)


@pytest.mark.parametrize("few", [50, 0])
def test_heavy_labels_are_salted(spark, rows, monkeypatch, few):
    monkeypatch.setattr(keys, "HOT_ROWS", few)
    df = frame(spark, [(7, f"v{i}") for i in range(300)] + [(i, "w") for i in range(100, 130)] + [(None, "n")] * 90)
    limits = spark.createDataFrame([(7, 1.0), (7, 2.0), (101, 3.0), (None, 4.0), (999, 5.0)], "k int, x double")
    got = keys.salted_left_join(df, limits, "k")
    assert rows(got) == rows(df.join(limits, "k", "left")) and got.columns == ["k", "v", "x"]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in text


def test_duplicates(spark, rows):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")])
    assert rows(keys.duplicates(df, ["k"])) == [(1, 2), (None, 2)]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_hot_keys_are_split_without_changing_the_result(spark, rows, monkeypatch, how):
    hot = [(7, f"v{i}") for i in range(600)]
    df = frame(spark, hot + [(i, "w") for i in range(100, 400)] + [(None, "n")] * 300)
    wanted = frame(spark, [(7, ""), (101, ""), (399, ""), (None, "")])
    plain = rows(keys.keep_keys(df, wanted, ["k"], how=how, split_hot=False))
    monkeypatch.setattr(keys, "HOT_ROWS", 50)
    mine, _ = keys.join_keys(df, wanted, ["k"])
    assert len(keys.hot_key_hashes(df, mine)) == 2
    split = keys.keep_keys(df, wanted, ["k"], how=how)
    assert "Union" in split._jdf.queryExecution().optimizedPlan().toString()
    assert rows(split) == plain


def test_sample_keys_do_not_depend_on_partitioning(spark, rows):
    df = spark.range(1000).withColumnRenamed("id", "k")
    picked = [rows(keys.sample_keys(df.repartition(n), ["k"], 10)) for n in (1, 7)]
    assert picked[0] == picked[1] and len(picked[0]) == 10
    assert rows(keys.sample_keys(df, ["k"], 10, seed=1)) != picked[0]


@pytest.mark.parametrize("n", [0, 1, 37, 400, 998, 1003, 5000])
def test_large_samples_are_cut_by_a_bound(spark, rows, monkeypatch, n):
    df = spark.range(1000).selectExpr("id AS k", "if(id % 3 = 0, NULL, CAST(id AS STRING)) AS s")
    df = df.unionByName(df.where("k < 200"))
    wanted = rows(keys.sample_keys(df, ["k", "s"], n))
    monkeypatch.setattr(keys, "ONE_TASK", -1)
    if n:
        assert rows(keys.sample_keys(df.repartition(5), ["k", "s"], n)) == wanted and len(wanted) == min(n, 1000)
    monkeypatch.setattr(keys, "HASHES", 1 << 52)  # bounds far too low are raised, and many hashes lie above all of them
    if n in (37, 400):
        assert rows(keys.sample_keys(df, ["k", "s"], n)) == wanted


def test_subset_cuts_the_larger_side(spark, rows):
    small, large = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(1, "x"), (1, "y"), (3, "z")])
    assert rows(keys.subset_pair(small, large, ["k"])[1]) == [(1, "x"), (1, "y")]
    assert rows(keys.subset_pair(large, small, ["k"])[0]) == [(1, "x"), (1, "y")]
    none = frame(spark, [(9, "q")])
    assert keys.subset_pair(none, large, ["k"])[2] is False
    assert keys.subset_pair(small, small, ["k"])[2] is False


def test_set_operations(spark, rows):
    a, b = frame(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "c")]), frame(spark, [(1, "a"), (None, "c")])
    assert rows(keys.key_intersection(a, b, ["k"])) == [(1,), (None,)]
    assert rows(keys.key_difference(a, b, ["k"])) == [(2,)]
    assert rows(keys.row_difference(a, b)) == [(1, "a"), (2, "b")]
    assert rows(keys.row_surplus(a, b)) == [(1, "a", 1), (2, "b", 1)]


def test_count_up_in_pieces(spark, rows):
    df = spark.createDataFrame([("a", 5, 1), ("b", 10, 25), ("c", 0, 7)], "x string, s bigint, n bigint")
    got = rows(keys.count_up(df, "s", "n", "i", chunk=7).select("x", "i"))
    assert got == sorted([("a", 5)] + [("b", 10 + i) for i in range(25)] + [("c", i) for i in range(7)], key=repr)


def test_first_n_per_group(spark, rows):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert rows(keys.first_n(df, ["id"], 2, "g").select("g", "id")) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_broadcast_only_if_small(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(keys.broadcast_if_small(spark.range(5)))
    assert "ResolvedHint" not in plan(keys.broadcast_if_small(spark.range(50), rows=10))


def test_key_sets_are_one_aggregate(spark):
    """No join holds the keys of both sides once more; null and repeated keys count as before."""
    s = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None), (4, "d")], "a int, b string")
    t = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (3, None)], "a int, b string")
    sets = keys.key_sets(s, t, ["a", "b"])
    assert "Join" not in sets._jdf.queryExecution().executedPlan().toString()
    assert sets.columns == ["__k0", "__k1", "__k2", "__k3", "s_n", "t_n"]
    assert sorted((r.s_n, r.t_n) for r in sets.collect() if r.s_n and r.t_n) == [(1, 2), (2, 1)]
    assert [r.s_n for r in sets.where("t_n IS NULL").collect()] == [1, 1] and [r.t_n for r in sets.where("s_n IS NULL").collect()] == [1]
    assert tuple(keys.symmetric_difference(sets).first()) == (2, 1, 3)


@pytest.mark.parametrize("few", [10, 1000])
def test_large_frames_are_cut_by_rows_a_task(spark, rows, monkeypatch, few):
    """The parts follow the number of rows, not compressed bytes; the rows kept are the same."""
    monkeypatch.setattr(keys, "PART_ROWS", 25)
    monkeypatch.setattr(keys, "ONE_TASK", few)
    df = frame(spark, [(i % 190, f"v{i}") for i in range(400)] + [(None, "n"), (None, "n")])
    df = df.where("k < 100 OR k IS NULL").union(df.where("k >= 100"))
    wanted = frame(spark, [(i * 2, "x") for i in range(90)] * 2 + [(None, "y")])
    kept = keys.keep_keys(df, wanted, ["k"])
    assert rows(kept) == sorted([(r.k, r.v) for r in df.collect() if r.k is None or r.k % 2 == 0 and r.k < 180], key=repr)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ("17), REPARTITION_BY_NUM" in plan) == (few == 10)
    gone = keys.keep_keys(df, wanted, ["k"], how="left_anti")
    assert kept.count() + gone.count() == df.count()
