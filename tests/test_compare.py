import os
import random

import pytest
from pyspark.sql import functions as F

from twinframe.operators import compare, keys


def pair_of(spark, s, t, schema="k int, a string, b double", how="full_outer", mode="canonical"):
    return keys.key_pair(spark.createDataFrame(s, schema), spark.createDataFrame(t, schema), ["k"], mode, how)


def test_mismatches(spark, rows):
    pair = pair_of(spark, [(1, "x", 1.0), (2, "007", None), (3, None, float("nan")), (4, "p", 2.0)],
                   [(1, "y", 1.0), (2, "7", 2.5), (3, None, None), (5, "p", 2.0)])
    assert rows(compare.mismatches(pair).select("pk", "column", "source_value", "target_value")) == [
        ("k=1", "a", "'x'", "'y'"), ("k=2", "b", "nan", "2.5")]
    assert rows(compare.mismatch_counts(pair)) == [("a", 3, 1), ("b", 3, 1), ("k", 3, 0)]


def test_same_data_has_no_findings(spark):
    data = [(i, f"v{i}", float(i)) for i in range(50)]
    pair = pair_of(spark, data, data[::-1])
    found = compare.findings(pair, tuple(compare.TEXT_RULES), True)
    assert compare.finding_counts(found).count() == 0
    assert found.agg(F.count_if("both")).first()[0] == 50


def test_swapping_sides_mirrors_counts(spark):
    s = [(i, "a", 1.0) for i in range(10)]
    t = [(i, "b" if i % 2 else "a", 1.0) for i in range(5, 17)] + [(6, "c", 1.0)]
    count = lambda x, y: {(r["kind"], r["column"]): r["n"] for r in compare.finding_counts(compare.findings(pair_of(spark, x, y))).collect()}
    there, back = count(s, t), count(t, s)
    assert there["source_only", ""] == back["target_only", ""] == 5
    assert there["target_only", ""] == back["source_only", ""] == 7
    assert there["target_dup", ""] == back["source_dup", ""] == 1
    assert there["value", "a"] == back["value", "a"]


def test_result_does_not_depend_on_partitioning(spark, rows):
    data = [(i % 40, f"v{i % 7}", float(i)) for i in range(200)]
    other = [(k, a.upper() if k % 3 else a, b) for k, a, b in data]
    schema = "k int, a string, b double"
    out = []
    for n in (1, 7):
        s, t = (spark.createDataFrame(random.sample(x, len(x)), schema).repartition(n) for x in (data, other))
        pair = keys.key_pair(s, t, ["k"])
        out.append((rows(compare.mismatch_examples(pair)), rows(compare.text_check(pair))))
    assert out[0] == out[1]


def test_text_check_and_sample(spark):
    s = [(i, "Ab", 1.0) for i in range(20)]
    t = [(i, "aB" if i >= 10 else "Ab", 1.0) for i in range(20)]
    pair = pair_of(spark, s, t)
    hits = lambda n: {r.validation: (r.hits, r.pk) for r in compare.text_check(pair, sample_rows=n).collect()}
    assert hits(None)["case_sensitivity_check"] == (10, "k=10")
    assert hits(10)["case_sensitivity_check"] == (0, None)


def test_checksum_parity_sees_extra_columns(spark):
    s = spark.createDataFrame([(1, "a", "b")], "k int, a string, b string")
    t = s.withColumn("c", F.lit("x"))
    pair = keys.key_pair(s, t, ["k"])
    assert compare.checksum_counts(compare.row_hashes(pair)).first()["mismatches"] == 0
    assert compare.checksum_counts(compare.row_hashes(pair, parity=True)).first()["mismatches"] == 1
    assert compare.checksum_counts(compare.row_hashes(pair, "sha256")).first()["mismatches"] == 0


def test_nested_and_binary_columns(spark):
    schema = "k int, a array<int>, m map<string,int>, b binary"
    s = spark.createDataFrame([(1, [1, 2], {"x": 1}, b"7"), (2, [1], {"x": 1}, b"q")], schema)
    t = spark.createDataFrame([(1, [1, 2], {"x": 1}, b"007"), (2, [2], {"x": 2}, b"r")], schema)
    counts = {r["column"]: r["mismatches"] for r in compare.mismatch_counts(keys.key_pair(s, t, ["k"])).collect()}
    assert counts == {"a": 1, "b": 1, "k": 0, "m": 1}


def brute_positions(s, t, columns):
    text = lambda v: "nan" if v is None else str(v)
    order = lambda data: sorted([tuple(text(r[c]) for c in columns) for r in data])
    a, b = order(s), order(t)
    counts = {c: 0 for c in columns}
    cells = []
    for i, (x, y) in enumerate(zip(a, b)):
        for c, v, w in zip(columns, x, y):
            if v != w:
                counts[c] += 1
                cells.append((i, c, f"'{v}'", f"'{w}'"))
    return counts, cells


@pytest.mark.parametrize("seed", range(4))
def test_positional_compare_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: [{"a": rng.choice(["p", "q", "r", None]), "b": rng.choice("xyz")} for _ in range(n)]
    # A third of all rows is one and the same row.
    s, t = pick(300) + [{"a": "q", "b": "y"}] * 900, pick(500) + [{"a": "q", "b": "y"}] * 250
    frames = [spark.createDataFrame([(r["a"], r["b"]) for r in x], "a string, b string").repartition(3) for x in (s, t)]
    segments = compare.positional_segments(*frames).persist()
    counts, cells = brute_positions(s, t, ["a", "b"])
    got = {r["column"]: (r["compared"], r["mismatches"]) for r in compare.positional_mismatch_counts(segments).collect()}
    assert got == {c: (750, n) for c, n in counts.items()}
    examples = [tuple(r) for r in compare.positional_mismatch_examples(segments, 100).collect()]
    assert examples == sorted(cells)[:100]
    segments.unpersist()


def test_positional_compare_with_empty_side(spark):
    s = spark.createDataFrame([("x",)], "a string")
    segments = compare.positional_segments(s, s.limit(0))
    assert [tuple(r) for r in compare.positional_mismatch_counts(segments).collect()] == [("a", 0, 0)]


def test_sorted_rows_are_written_small(spark):
    """The sorted rows, which are alike, are stored with zstd; positions are those of the text sort."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i % 7, "x") for i in range(50)], "a int, b string")
    placed = compare.sorted_positions(df, ["a", "b"]).orderBy("position").collect()
    assert [(r.position, r.a) for r in placed] == list(enumerate(sorted(str(i % 7) for i in range(50))))
    found = [f for d in set(os.listdir(folder)) - before if d.startswith("sorted-") for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")]
    assert found and all(f.endswith(".zstd.parquet") for f in found)
