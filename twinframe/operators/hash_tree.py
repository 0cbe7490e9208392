"""Differing rows of two datasets by a tree of hashes: only what differs is joined.

A leaf is a range of hashed keys. Each side sums the hashes of its rows by leaf,
in any order and combined in the tasks; nodes sum their leaves. From the root
down, only children of nodes that differ are looked at, and only rows of leaves
that differ are joined. Equal datasets join no rows.
"""

from pyspark.sql import functions as F

from twinframe.functions.values import as_text, atomic_frame, name
from twinframe.operators import compare
from twinframe.operators.keys import join_keys, key_pair, names_of
from twinframe.shared import written

#: Leaves of a tree, and children of a node. The differing leaves, at most LEAVES numbers, are broadcast.
LEAVES, WIDTH = 1 << 16, 16


def _leaf(names):
    return F.pmod(F.xxhash64(*names), F.lit(LEAVES))


def _row(df, columns):
    """Hash of a row, equal where all cells read the same."""
    cells = [as_text(name(c), df.schema[c].dataType) for c in columns]
    return F.expr(f"xxhash64({', '.join(cells) or '0'})")


def tree_leaves(df, key_columns, columns):
    """leaf, n, low, high: rows and sums of both halves of their hashes, one row a leaf that has rows."""
    names = names_of(key_columns)
    rows = df.select(*key_columns, _row(df, columns).alias("h")).select(_leaf(names).alias("leaf"), F.xxhash64("h", *names).alias("h"))
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
                                    F.sum(F.shiftright("h", 32)).alias("high"))


def _unlike(one, two):
    """Numbers of the nodes whose sums differ, or that only one side has."""
    sums = ["n", "low", "high"]
    sides = [x.select("leaf", F.struct(*sums).alias(c)) for x, c in ((one, "one"), (two, "two"))]
    return sides[0].join(sides[1], "leaf", "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select("leaf")


def differing_leaves(one, two):
    """(the numbers of leaves that differ, nodes compared), level by level from the root down."""
    depth, nodes, compared = 0, None, 0
    while WIDTH ** depth < LEAVES:
        depth += 1
    for level in range(depth, -1, -1):
        sides = []
        for leaves in (one, two):
            if nodes is not None:  # children of the nodes that differ
                leaves = leaves.where(F.floor(F.col("leaf") / WIDTH ** (level + 1)).isin(nodes) if len(nodes) <= 1000 else F.lit(True))
            sides.append(leaves.groupBy(F.floor(F.col("leaf") / WIDTH ** level).alias("leaf")).agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]))
        compared += 1 if nodes is None else WIDTH * len(nodes)
        nodes = sorted(r.leaf for r in _unlike(*sides).collect())  # LEAVES numbers at most
        if not nodes:
            break
    return nodes, compared


def row_differences(source, target, keys, mode="canonical", algo="md5"):
    """pk, source_hash, target_hash of the keys on both sides whose rows' hashes differ.

    The result is that of comparing the hashes of all matched rows. The leaves are
    written once. A key is represented by its smallest row.
    """
    source, target = atomic_frame(source), atomic_frame(target)
    columns = sorted(set(source.columns) & set(target.columns))
    own = join_keys(source, target, keys, mode)
    leaves = [written(tree_leaves(df, cols, columns), "leaves") for df, cols in zip((source, target), own)]
    nodes, _ = differing_leaves(*leaves)
    if not nodes:
        source, target = source.where("false"), target.where("false")
    marks = source.sparkSession.createDataFrame([(n,) for n in nodes], "__leaf bigint")
    sides = []
    for df, cols in zip((source, target), own):
        listed = [name(c) for c in df.columns]
        rows = df.select(*listed, *cols).withColumn("__leaf", _leaf(names_of(cols)))
        sides.append(rows.join(F.broadcast(marks), "__leaf", "left_semi").select(*listed))  # LEAVES rows at most
    hashes = compare.row_hashes(key_pair(*sides, keys, mode, "inner"), algo)
    return hashes.where("source_hash <> target_hash").select("pk", "source_hash", "target_hash")
