"""Merkle manifest of a dataset, level by level with lag and lead windows, in DataFrame functions only.

Every row is a leaf. Within a group, here a source, the nodes of a level stand in
order, and runs of `width` consecutive ones have one parent. A level is a
window over the nodes: lag and lead columns of fixed offsets 1 to width - 1 bring
the neighbours, masked by a node's slot in its run and by the run's length, so
that only siblings remain. The first child of each run hashes the parent and
takes over what is below it, so that proofs grow on the way up.

STEPS levels make one pass: the nodes above a block of width ** STEPS neighbours
need nothing from outside, so a pass has one shuffle, and one group with most of
the rows is spread over as many tasks as it has blocks. Each pass is written once
and has one row a block, on which the next pass builds. The roots of the groups
make one more such tree. Coming down, every pass is joined once.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.shared import new_path

#: Plan setting only: levels of one pass.
STEPS = 5

#: Names of the working columns.
GROUP, AT, SIZE, NODE, BLOCK, BELOW = "__group", "__at", "__size", "__node", "__block", "__below"
PROOF = "array<struct<left:binary,right:binary>>"


def leaf_digest(*columns):
    """SHA-256 of the columns one after the other, each `-` if null, else its UTF-8 byte count, `:` and its text."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexadecimal(digests):
    return F.lower(F.hex(digests))


def node_digest(*digests):
    """SHA-256 of digests as hexadecimal text, one after the other."""
    return F.unhex(F.sha2(F.concat(*[hexadecimal(d) for d in digests]), 256))


def _stored(df, label):
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows, order):
    """The rows with their place AT (from 0) in their GROUP by `order`, and the group's SIZE.

    One range sort over all groups; a row number breaks ties, so that equal rows
    spread as well. What is counted after it has one row a group and sorted part.
    """
    rows = (rows.withColumn("__tie", F.monotonically_increasing_id()).orderBy(GROUP, *order, "__tie").drop("__tie")
            .withColumn("__row", F.monotonically_increasing_id()))
    rows = _stored(rows, "leaves").withColumn("__part", F.shiftright("__row", 33))
    counted = rows.groupBy(GROUP, "__part").agg(F.count("*").alias("__rows"), F.min("__row").alias("__first"))
    before = Window.partitionBy(GROUP).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(GROUP, "__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
                             F.sum("__rows").over(Window.partitionBy(GROUP)).alias(SIZE))
    return (rows.join(counted, [GROUP, "__part"])
            .withColumn(AT, F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__first", "__before"))


def level_up(nodes, width):
    """The next level of a block's nodes; `below` gathers the rows below a node, each with its proof so far.

    A group whose last node is reached stays as it is.
    """
    run = Window.partitionBy(GROUP, BLOCK).orderBy(AT)
    slot, more = F.col(AT) % width, F.col(SIZE) > 1
    length = F.least(F.lit(width), F.col(SIZE) - F.col(AT) + slot)
    left = [F.when(slot >= k, F.lag(NODE, k).over(run)).otherwise(F.lit(b"")) for k in range(width - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead(NODE, k).over(run)).otherwise(F.lit(b"")) for k in range(1, width)]
    step = F.struct(F.col("__left").alias("left"), F.col("__right").alias("right"))
    own = F.transform(BELOW, lambda b: F.struct(b["row"].alias("row"), F.array_append(b["proof"], step).alias("proof")))
    known = (nodes.withColumn("__left", F.concat(*left)).withColumn("__right", F.concat(*right))
             .withColumn(BELOW, F.when(more, own).otherwise(F.col(BELOW))))
    others = [F.when(slot + k < length, F.lead(BELOW, k).over(run)) for k in range(1, width)]
    gathered = known.withColumn("__all", F.flatten(F.array_compact(F.array(BELOW, *others))))
    return gathered.where(slot == 0).select(
        GROUP, BLOCK, F.floor(F.col(AT) / width).alias(AT), F.floor((F.col(SIZE) + width - 1) / width).alias(SIZE),
        F.when(more, node_digest(NODE, "__right")).otherwise(F.col(NODE)).alias(NODE), F.col("__all").alias(BELOW))


def tree(leaves, carried, width):
    """(passes from the leaves up, roots) of placed leaves, which bring the columns `carried` along.

    A pass has a row a block: GROUP, AT (the block), SIZE (blocks of the group), NODE and what is below.
    """
    passes, nodes, row = [], leaves, F.struct(*carried)
    most = leaves.agg(F.max(SIZE)).first()[0] or 1
    while True:
        level = nodes.select(GROUP, AT, SIZE, NODE, F.floor(F.col(AT) / width ** STEPS).alias(BLOCK),
                             F.array(F.struct(row.alias("row"), F.array().cast(PROOF).alias("proof"))).alias(BELOW))
        for _ in range(STEPS):
            if most > 1:
                level, most = level_up(level, width), -(-most // width)
        passes.append(_stored(level.drop(BLOCK), "manifest"))
        if most == 1:
            break
        nodes, row = passes[-1].where(F.col(SIZE) > 1), F.struct(AT)
    roots = passes[0].where(F.col(SIZE) == 1).select(GROUP, NODE)
    for more in passes[1:]:
        roots = roots.unionByName(more.where(F.col(SIZE) == 1).select(GROUP, NODE))
    return passes, roots


def proofs(passes, roots):
    """The leaves' carried columns with those of their group's row in `roots` (GROUP, proof, ...) and their whole proofs.

    `roots` is joined where a group ends, once a group; all other joins are of a block with its one row above.
    """
    carried = [F.col(c) for c in roots.columns if c not in (GROUP, "proof")]
    above = None
    for level in reversed(passes):
        known = level.where(F.col(SIZE) == 1).select(GROUP, BELOW).join(roots, GROUP).select(GROUP, BELOW, *carried, "proof")
        if above is not None:
            known = known.unionByName(level.where(F.col(SIZE) > 1).select(GROUP, AT, BELOW).join(above, [GROUP, AT])
                                      .select(GROUP, BELOW, *carried, "proof"))
        above = (known.select(GROUP, *carried, F.col("proof").alias("__up"), F.inline(BELOW))
                 .select(GROUP, *carried, "row.*", F.concat("proof", "__up").alias("proof")))
    return above.drop(GROUP)


def merkle_manifest(leaves, group, order, width=3):
    """The columns of `leaves` with subroot, root and proof (of every row, up to the root).

    `leaves` has a binary column `leaf` (see `leaf_digest`). Within a `group` leaves
    ascend by `order`, then by digest. While several nodes remain, every `width`
    consecutive ones become one, of which the last may have fewer children, even
    one. A group's last node is its subroot; the subroots, ordered by group (null
    first, then by UTF-8 bytes), likewise give the root. `proof` is an array of the
    siblings' digests to the left and right, level by level; `fold` climbs it.

    Defined results: a null group is a group of its own, null order values come
    first. Rows that are equal in `order` and digest may change places, which
    changes no node. A group of one row has its leaf as subroot. No rows give
    none. Other columns are carried along and should be narrow, as a block's rows travel together; names that begin with two underscores
    and subroot, root, proof are taken.
    """
    keyed = leaves.withColumn(GROUP, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    passes, subroots = tree(placed(keyed.withColumn(NODE, F.col("leaf")), [*order, NODE]), leaves.columns, width)
    # one more tree, whose only group holds a leaf for each group
    tops = subroots.select(F.lit("").alias(GROUP), F.col(GROUP).alias("of"), NODE)
    high, root = tree(placed(tops, ["of"]).withColumn("subroot", F.col(NODE)), ["of", "subroot"], width)
    start = root.select(GROUP, F.col(NODE).alias("root"), F.array().cast(PROOF).alias("proof"))
    found = proofs(passes, proofs(high, start).withColumnRenamed("of", GROUP))
    return found.select(*leaves.columns, "subroot", "root", "proof")


def fold(leaf, proof):
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: node_digest(step["left"], node, step["right"]))


def proof_digest(proof):
    """SHA-256 of all digests of a proof as hexadecimal text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(hexadecimal(s["left"]), hexadecimal(s["right"]))), ""), 256)


def document_manifest(docs):
    """The columns of op13: digests of all documents by source, and whether the tampered documents still fold to the root.

    Where crc32 of the decimal doc_id is even, tampering deletes the text's line
    feeds. A null doc_id is not tampered with. See `merkle_manifest` for the rest.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"),
                       F.col("n_chars").cast("long"), F.col("text").cast("string"))
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    before = ["doc_id", "source", "lang", "n_chars"]
    leaves = rows.select("doc_id", "source", leaf_digest(*before, "text").alias("leaf"), leaf_digest(*before, text).alias("tampered"))
    found = merkle_manifest(leaves, "source", ["doc_id"]).withColumn("folded", fold(F.col("tampered"), F.col("proof")))
    return found.select("doc_id", *[hexadecimal(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                        proof_digest(F.col("proof")).alias("proof_sha256"), hexadecimal(F.col("folded")).alias("folded_root"),
                        (F.col("folded") == F.col("root")).alias("verified"))
