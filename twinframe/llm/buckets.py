"""Candidate pairs of MinHash buckets, by DataFrame functions."""

from pyspark.sql import functions as F

from twinframe.shared import written

#: Plan setting only: members of one block.
BLOCK = 2048


def buckets(keys, roots, folders):
    """Members (key, band, id, root, n, pivot, pivot_root) of the buckets that hold more than one component."""
    rooted = keys.withColumn("root", F.col("id"))
    if roots is not None:
        rooted = keys.join(roots, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
    shared = (rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot"),
                                        F.min("root").alias("low"), F.max("root").alias("high"))
              .where("n > 1 and low <> high").select("key", "n", "pivot", F.col("pivot").alias("pivot_root")))
    # written, so that its shuffle is gone before all keys are joined to it
    shared = written(shared, "shared-keys", folders)
    if roots is not None:
        named = roots.select(F.col("id").alias("pivot"), "component")
        shared = (shared.join(named, "pivot", "left").withColumn("pivot_root", F.coalesce("component", "pivot"))
                  .drop("component"))
    return rooted.join(shared, "key")


def shared_buckets(keys):
    """Members (key, id, root, n, pivot, pivot_root) of the buckets with two ids or more, each id its own root.

    The keys are dealt out once, for the counts and for what is joined to them, and no part is sorted.
    """
    dealt = keys.repartition("key")
    shared = (dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), F.max("id").alias("high"))
              .where("pivot <> high").select("key", "n", "pivot"))
    return (dealt.join(shared.hint("shuffle_hash"), "key")
            .select("key", "id", F.col("id").alias("root"), "n", "pivot", F.col("pivot").alias("pivot_root")))


def candidates(members, small):
    """Distinct pairs of different components: with the pivot, and all of a bucket of at most `small` members."""
    star = members.where("id <> pivot and root <> pivot_root").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    few = members.where((F.col("n") <= small) & (F.col("n") > 2) & (F.col("id") != F.col("pivot")))
    left = few.select("key", F.col("id").alias("a"), F.col("root").alias("root_a"))
    right = few.select("key", F.col("id").alias("b"), F.col("root").alias("root_b"))
    return star.union(left.join(right, "key").where("a < b and root_a <> root_b").select("a", "b")).distinct()


def with_outside(members):
    """The members with `main`, the largest component of their bucket, and how many members are `outside` it."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max_by("root", "m").alias("main"), (F.sum("m") - F.max("m")).alias("outside"))
    return members.join(most, "key")


def outside_pairs(members, few, more, alike):
    """Distinct pairs of different components, of all members of a bucket against those outside its largest component.

    `alike` decides on the columns `more` of both (c_one and c_two) inside the
    join, so pairs that it drops are never written. Both sides are dealt into
    blocks of BLOCK members, but up to `few` outsiders stay together.
    """
    many = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("of_two"), F.first("outside").alias("outside"))
    many = many.select("key", "of_two", F.when(F.col("outside") <= few, F.lit(1).cast("long"))
                       .otherwise(F.ceil(F.col("outside") / BLOCK)).alias("of_one"))
    dealt = members.join(many, "key")
    side = {}
    for name, other, rows in (("one", "two", dealt.where("root <> main")), ("two", "one", dealt)):
        side[name] = rows.select(
            "key", F.pmod(F.xxhash64("id"), f"of_{name}").alias(f"block_{name}"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"of_{other}") - 1)).alias(f"block_{other}"),
            F.col("main").alias(f"main_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in ("id", "root", *more)])
    # of two outsiders each meets the other; one of the two meetings is enough
    once = (F.col("root_two") == F.col("main_two")) | (F.col("id_one") < F.col("id_two"))
    return (side["one"].join(side["two"], ["key", "block_one", "block_two"]).where((F.col("root_one") != F.col("root_two")) & once & alike)
            .select(F.least("id_one", "id_two").alias("a"), F.greatest("id_one", "id_two").alias("b")).distinct())
