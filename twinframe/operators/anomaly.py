"""Outlier detection with an Isolation Forest (Liu, Ting and Zhou, 2008).

Trees are grown from bounded samples in parallel tasks; scoring is one
vectorised pass over the data with the forest broadcast (its size depends only
on the number of trees and the sample size).
"""

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.ranks import interpolated
from twinframe.shared import kept

log = logging.getLogger(__name__)

N_TREES = 100
SAMPLE_SIZE = 256
LARGEST_SAMPLE = 1 << 14  # rows of a tree that a share of the table may come to
HEAVY = 250  # a point with one in so many rows is always in the pool

# Errors that readers of reports look for.
MISSING, NOT_NUMERIC, NO_ROWS = "Missing columns: {names}", "No numeric columns to analyze", "No valid data after removing NaNs"

# A tree is complete: node i has the children 2i + 1 and 2i + 2, `path` is the
# path length at each leaf. Early leaves are continued with splits that all
# rows pass on the left.
TREE_SCHEMA = "tree_id int, size int, depth int, feature array<int>, threshold array<double>, path array<double>"


def numeric_columns(df, columns):
    """The numeric ones of the named columns; a missing name or none left is an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(MISSING.format(names=absent))
    usable = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    if len(usable) < len(columns):
        log.warning("non-numeric columns skipped: %s", sorted(set(columns) - set(usable)))
    if not usable:
        raise ValueError(NOT_NUMERIC)
    return usable


def _doubles(df, columns):
    return [F.col(c).cast("double").alias(c) for c in columns]


def _complete(columns):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def training_pool(df, columns, n_trees=N_TREES, size=SAMPLE_SIZE, seed=42):
    """(points, copies, rows to draw for a tree): what all trees draw from, of bounded size.

    The points whose seeded hash is below a bound, with the number of their rows:
    all points of a small table, of a large one about as many as the trees draw.
    Rows beyond the bound end where they are read, so only points of the pool
    shuffle, counted in each task first. A point that holds one row in HEAVY is
    always there, its copies reduced like those of the others. The pool depends
    on the rows alone, not on their order or partitioning.

    A `size` that is a float is a share of the complete rows, of at most
    LARGEST_SAMPLE rows.
    """
    points = df.where(_complete(columns)).select(*_doubles(df, columns))
    h = F.xxhash64(*columns, F.lit(seed))
    seen = points.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.01).alias("distinct"),
        F.expr(f"approx_top_k(h, {2 * HEAVY}, {40 * HEAVY})").alias("top")).first()
    if not seen.n:
        raise ValueError(NO_ROWS)
    if isinstance(size, float):
        if not 0 < size <= 1 or size * seen.n > LARGEST_SAMPLE:
            raise ValueError(f"max_samples {size} is no share, or more than {LARGEST_SAMPLE} of {seen.n} rows")
        size = max(int(size * seen.n), 1)
    if size < 1:
        raise ValueError(f"max_samples {size} is no number of rows")
    share = min(1.0, max(n_trees * SAMPLE_SIZE, 8 * size) / max(seen.distinct, 1))
    low = F.pmod(F.xxhash64(h, F.lit("pool")), F.lit(1 << 40)) < int(share * (1 << 40))
    many = [t["item"] for t in seen.top or [] if t["count"] * HEAVY >= seen.n / 2]  # among them all that hold one row in HEAVY
    pool = (points.where(low | h.isin(many)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            .where(low | (F.col("n") * HEAVY >= seen.n)).select(*columns, "n", h.alias("h")).toPandas())
    pool = pool.sort_values(["h", *columns])
    copies = pool["n"].to_numpy()
    copies = np.where(copies * HEAVY >= seen.n, np.maximum(np.rint(copies * share), 1), copies).astype(np.int64)
    return pool[columns].to_numpy(dtype=float), copies, min(size, seen.n), size


def training_samples(df, columns, n_trees=N_TREES, size=SAMPLE_SIZE, seed=42):
    """(tree_id, *columns): the rows each tree is grown from, drawn for each tree without replacement."""
    def rows(tree_id, points):
        out = pd.DataFrame(points, columns=columns)
        out.insert(0, "tree_id", np.int32(tree_id))
        return out
    schema = "tree_id int, " + ", ".join(f"`{c}` double" for c in columns)
    return _by_tree(df.sparkSession, training_pool(df, columns, n_trees, size, seed), n_trees, seed, rows, schema)


def _by_tree(spark, pool, n_trees, seed, rows, schema):
    """What `rows` makes of each tree's number and draw, trees spread over the cores. Nothing is shuffled."""
    sent = spark.sparkContext.broadcast(pool)  # at most LARGEST_SAMPLE * 8 or n_trees * SAMPLE_SIZE points, and HEAVY

    def each(batches):
        points, copies, k, _ = sent.value
        ends = np.cumsum(copies)
        for batch in batches:
            for tree_id in batch["id"].tolist():
                places = np.random.default_rng([seed, tree_id]).choice(ends[-1], min(k, ends[-1]), replace=False)
                yield rows(tree_id, points[np.searchsorted(ends, places, "right")])

    trees = spark.range(0, n_trees, numPartitions=min(n_trees, spark.sparkContext.defaultParallelism))
    return trees.mapInPandas(each, schema)


def fit_forest(df, columns, n_trees=N_TREES, size=SAMPLE_SIZE, seed=42):
    """One row per tree with its nodes as arrays."""
    pool = training_pool(df, columns, n_trees, size, seed)
    size = pool[-1]

    def average_path(n):
        if n <= 2:
            return float(n == 2)
        return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    depth = math.ceil(math.log2(max(size, 2)))

    def grow(tree_id, x):
        rng = np.random.default_rng([seed, tree_id, 1])
        inner = 2 ** depth - 1
        feature, threshold = np.zeros(inner, dtype=int), np.full(inner, np.inf)
        path = np.zeros(inner + 1)

        def node(at, rows, level):
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            choices = np.flatnonzero(hi > lo) if level < depth else ()
            if not len(choices):
                leftmost = (at + 1) * 2 ** (depth - level) - 1
                path[leftmost - inner] = level + average_path(len(rows))
                return
            f = rng.choice(choices)
            split = rng.uniform(lo[f], hi[f])
            below = x[rows, f] <= split
            feature[at], threshold[at] = f, split
            node(2 * at + 1, rows[below], level + 1)
            node(2 * at + 2, rows[~below], level + 1)

        node(0, np.arange(len(x)), 0)
        return pd.DataFrame([{"tree_id": tree_id, "size": len(x), "depth": depth, "feature": feature,
                              "threshold": threshold, "path": path}])

    return _by_tree(df.sparkSession, pool, n_trees, seed, grow, TREE_SCHEMA)


def collect_forest(forest):
    """The trees as rows, for scoring more than once; bounded by trees times sample size."""
    return forest.orderBy("tree_id").collect()


def score_rows(df, columns, forest):
    """The frame with `anomaly_score`: near -1 for outliers, 0 for rows with a missing value.

    `forest` is the frame from `fit_forest` or its collected trees.
    """
    trees = forest if isinstance(forest, list) else collect_forest(forest)
    size, depth = max(t.size for t in trees), trees[0].depth
    norm = 2.0 * (math.log(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size if size > 2 else 1.0
    sent = df.sparkSession.sparkContext.broadcast([
        (np.array(t.feature), np.array(t.threshold), np.array(t.path)) for t in trees])

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        cells = np.stack([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        n = cells.shape[1]
        missing = np.isnan(cells).any(axis=0)
        flat, rows, total = cells.ravel(), np.arange(n), np.zeros(n)
        for feature, threshold, path in sent.value:
            offset = feature * n
            at = np.zeros(n, dtype=np.intp)
            for _ in range(depth):
                above = flat.take(offset.take(at) + rows) > threshold.take(at)
                at = 2 * at + 1 + above
            total += path.take(at - len(feature))
        scores = -np.power(2.0, -total / len(sent.value) / norm)
        scores[missing] = 0.0
        return pd.Series(scores)

    return df.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in columns]))


def score_threshold(scored, columns, contamination=0.02):
    """One row with the exact score below which the given share of complete rows lies; null without complete rows.

    The threshold is between the scores of the ranks around (n - 1) * contamination.
    Scores below it are anomalies: floor((n - 1) * contamination) rows if that is a
    whole number, else one more, and fewer where rows tie at the threshold.
    """
    with kept(scored.where(_complete(columns)).select(*columns, "anomaly_score"), "scores") as scores:
        return scored.sparkSession.createDataFrame([(stored_threshold(scores, columns, contamination),)], "threshold double")


def stored_threshold(scored, columns, contamination=0.02):
    """The threshold of scored rows that are stored, so that reading them again does not score them again."""
    return interpolated(scored.where(_complete(columns)), "anomaly_score", contamination)


def mark_anomalies(scored, columns, threshold):
    """The scored frame with `is_anomaly`; rows with a missing value are never anomalies."""
    return scored.withColumn("is_anomaly", _complete(columns) & (F.col("anomaly_score") < F.lit(-2.0 if threshold is None else threshold)))


def flag_anomalies(scored, columns, contamination=0.02):
    """The scored frame marked at the threshold the contamination gives."""
    return mark_anomalies(scored, columns, score_threshold(scored, columns, contamination).first()["threshold"])


def detect_anomalies(df, columns, contamination=0.02, seed=42, size=SAMPLE_SIZE, n_trees=N_TREES):
    """Fit on the frame, score and flag every row."""
    columns = numeric_columns(df, columns)
    forest = fit_forest(df, columns, n_trees, size, seed)
    return flag_anomalies(score_rows(df, columns, forest), columns, contamination)


def anomaly_summary(flagged):
    """Anomalies, all rows (those with missing values too) and the rate in percent."""
    counts = flagged.agg(F.count_if("is_anomaly").alias("anomalies"), F.count(F.lit(1)).alias("total_rows"))
    rate = F.when(F.col("total_rows") > 0, F.col("anomalies") / F.col("total_rows") * 100).otherwise(F.lit(0.0))
    return counts.withColumn("rate", rate).withColumn(
        "result", F.when(F.col("anomalies") == 0, F.lit("PASS")).otherwise(F.lit("WARN")))


def anomaly_ranges(flagged, columns):
    """Value range of each column among anomalies and among normal rows."""
    bad = F.col("is_anomaly")
    aggs, rows = [], []
    for i, c in enumerate(columns):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        for name, rule in (("anomaly", bad), ("normal", ~bad)):
            aggs += [F.min(F.when(rule, v)).alias(f"{name}_min_{i}"), F.max(F.when(rule, v)).alias(f"{name}_max_{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), *[
            F.col(f"{m}_{i}").alias(m) for m in ("anomaly_min", "anomaly_max", "normal_min", "normal_max")]))
    return flagged.agg(*aggs).select(F.inline(F.array(*rows)))


def top_anomalies(flagged, n=20, order=()):
    """The n rows with the lowest scores among the anomalies."""
    return flagged.where("is_anomaly").orderBy("anomaly_score", *order).limit(n)
