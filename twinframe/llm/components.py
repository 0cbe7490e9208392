"""Connected components of a link table by distributed union-find."""

import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.shared import written


def components(links, few=0):
    """(id, component): the smallest id reachable, for every id in `links` (a, b).

    Each round hooks every id to its smallest neighbour, halves the paths and
    contracts the links, until none is left. All rounds are
    aggregates with map-side combining and joins to unique keys, so an id with
    very many links is never gathered in one place. Null ids and self-links are
    dropped; without links the result is empty.

    Once at most `few` links are left, one task joins these; with 0, as operators
    without Python need it, rounds go on to the end.
    """
    links = written(_tidy(links.select("a", "b")), "links")
    rounds = []
    while not links.isEmpty():
        if few and links.count() <= few:
            rounds.append(written(links.coalesce(1).mapInArrow(_joined, "id long, up long"), "hooks"))
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up")),
                       "hooks")
        hook = (hook.join(hook.select(F.col("id").alias("up"), F.col("up").alias("next")), "up")
                .select("id", F.col("next").alias("up")))
        rounds.append(hook)
        a, b = (hook.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        links = written(_tidy(links.join(a, "a").join(b, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))),
                        "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = rounds[0]
    for hook in rounds[1:]:
        out = (out.join(hook.select(F.col("id").alias("up"), F.col("up").alias("root")), "up", "left")
               .select("id", F.coalesce("root", "up").alias("up")))
    return out.withColumnRenamed("up", "component")


def _tidy(links):
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(batches):
    """(id, smallest id reachable) of the ids of a bounded number of links."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["id", "up"])
