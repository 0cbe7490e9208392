import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import anomaly

COLUMNS = ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (1000, 2)))]
    data += [(1000 + i, 20.0 + i, -20.0 - i) for i in range(5)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    return spark.createDataFrame(data, "id int, x double, y double")


def test_planted_outliers_score_lowest(planted):
    flagged = anomaly.detect_anomalies(planted, COLUMNS, contamination=0.02).cache()
    assert {r.id for r in anomaly.top_anomalies(flagged, 5).collect()} == set(range(1000, 1005))
    s = anomaly.anomaly_summary(flagged).first()
    assert s.total_rows == 1007 and 12 <= s.anomalies <= 22 and s.result == "WARN"
    missing = flagged.where("id >= 2000").collect()
    assert [(r.anomaly_score, r.is_anomaly) for r in missing] == [(0.0, False)] * 2
    ranges = {r["column"]: r for r in anomaly.anomaly_ranges(flagged, COLUMNS).collect()}
    assert ranges["x"].anomaly_max == 24.0 and ranges["x"].normal_max < 20
    assert ranges["y"].anomaly_min == -24.0
    flagged.unpersist()


def test_same_seed_same_scores_for_any_partitioning(planted):
    def scores(df, seed):
        forest = anomaly.fit_forest(df, COLUMNS, n_trees=20, seed=seed)
        return {r.id: r.anomaly_score for r in anomaly.score_rows(df, COLUMNS, forest).collect()}
    first = scores(planted.repartition(1), 42)
    assert first == scores(planted.repartition(7), 42)
    assert first != scores(planted, 43)


def test_sample_is_bounded_and_proportional(spark):
    # A third of all rows is one row; it must hold about a third of the pool.
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("x"))
    samples = anomaly.training_samples(df, ["x"], n_trees=10, size=64)
    counts = samples.groupBy("tree_id").agg(F.count("*").alias("n"), F.count_if(F.col("x") == 1.0).alias("hot")).collect()
    assert [r.n for r in counts] == [64] * 10
    assert 0.2 < sum(r.hot for r in counts) / 640 < 0.5


def test_columns(planted, spark):
    assert anomaly.numeric_columns(planted.withColumn("s", F.lit("a")), ["x", "s"]) == ["x"]
    with pytest.raises(ValueError, match="Missing columns"):
        anomaly.numeric_columns(planted, ["z"])
    with pytest.raises(ValueError, match="No numeric"):
        anomaly.numeric_columns(planted.withColumn("s", F.lit("a")), ["s"])
    with pytest.raises(ValueError, match="No valid data"):
        anomaly.fit_forest(planted.where("x is null"), ["x"])


def test_constant_data_has_no_anomalies(spark):
    df = spark.range(50).select(F.lit(3.0).alias("x"))
    assert anomaly.anomaly_summary(anomaly.detect_anomalies(df, ["x"])).first().anomalies == 0


def test_draws_do_not_depend_on_order_or_partitions(spark):
    df = spark.range(40_000).select((F.col("id") % 30_011).cast("double").alias("x"), (F.col("id") % 7).cast("int").alias("y"))
    first = sorted(map(tuple, anomaly.training_samples(df.repartition(1), COLUMNS, 20, 64).collect()))
    other = sorted(map(tuple, anomaly.training_samples(df.orderBy(F.rand(3)).repartition(9), COLUMNS, 20, 64).collect()))
    assert first == other and len(first) == 20 * 64


def test_pool_of_many_points_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "SAMPLE_SIZE", 16)
    df = spark.range(100_000).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id")).cast("double").alias("x"))
    points, copies, k, size = anomaly.training_pool(df, ["x"], n_trees=10, size=16)
    assert (k, size) == (16, 16) and 100 < len(points) < 260
    heavy = copies[points[:, 0] == -1]
    assert len(heavy) == 1 and 0.15 < heavy[0] / copies.sum() < 0.35 and sorted(set(copies))[0] == 1


def test_only_the_pool_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "SAMPLE_SIZE", 16)
    df = spark.range(200_000).select(F.col("id").cast("double").alias("x"))
    before = {s for s in _shuffled(spark)}
    anomaly.training_pool(df, ["x"], n_trees=10, size=16)
    rows = [n for s, n in _shuffled(spark).items() if s not in before]
    tasks = df.rdd.getNumPartitions()
    assert rows and max(rows) <= tasks * 10 * 16


def _shuffled(spark):
    """Rows written to shuffles by stage, as Spark's own status store has them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_few_rows_are_all_drawn(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 3 + [(float("nan"),), (None,)], "x double")
    got = anomaly.training_samples(df, ["x"], n_trees=3, size=256).groupBy("tree_id", "x").count().collect()
    assert sorted(tuple(r) for r in got) == [(t, x, n) for t in range(3) for x, n in ((1.0, 5), (2.0, 3))]


def test_sample_size_as_a_share(planted):
    assert {t.size for t in anomaly.fit_forest(planted, COLUMNS, n_trees=3, size=0.1).collect()} == {100}
    assert {t.size for t in anomaly.fit_forest(planted, COLUMNS, n_trees=3, size=1.0).collect()} == {1005}
    for bad in (0.0, 1.5, -1, 0):
        with pytest.raises(ValueError, match="max_samples"):
            anomaly.fit_forest(planted, COLUMNS, n_trees=3, size=bad)


def test_flagged_rows_are_the_stated_share(planted):
    scored = anomaly.score_rows(planted, COLUMNS, anomaly.fit_forest(planted, COLUMNS, n_trees=20)).cache()
    scores = sorted(r.anomaly_score for r in scored.where("id < 2000").collect())
    for share in (0.02, 0.1, 0.37):
        limit = anomaly.score_threshold(scored, COLUMNS, share).first().threshold
        assert np.isclose(limit, np.quantile(scores, share), rtol=1e-14, atol=0)
        assert anomaly.flag_anomalies(scored, COLUMNS, share).where("is_anomaly").count() == sum(x < limit for x in scores)
    assert anomaly.score_threshold(scored.where("x is null"), COLUMNS).first().threshold is None
    assert anomaly.flag_anomalies(scored.where("x is null"), COLUMNS).where("is_anomaly").count() == 0
    scored.unpersist()
