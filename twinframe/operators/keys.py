"""Key columns, key sets, one-row-per-key frames and the joins on them.

Reductions to one row per key are aggregates, so a key that holds a large
share of all rows is combined before the shuffle. Joins of raw rows to a key
set split off heavy keys (see `keep_keys`).
"""

import math
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinframe.functions.types import DATES, TEXTS, type_class
from twinframe.functions.values import atomic_frame, canon, format_key, missing, name, without_nan
from twinframe.operators.bloom import bloom_filter, bloom_join
from twinframe.operators.ranks import around_rank
from twinframe.shared import written

HOT_ROWS = 1_000_000  # a key with fewer rows fits any task
HOT_SHARE = 0.002     # so at most 500 keys are hot
HOT_TRACKED = 1_000
SALTS = 64            # parts of a heavy key in a join that carries values
PART_ROWS = 250_000   # rows of one task in a join that cuts a large frame
ONE_TASK = 10_000     # keys that one task may order
HASHES = 1 << 60      # hashes that order a sample of keys


def _native_key(x, dtype):
    """Two never-null expressions that are equal exactly where the keys are (null equals null)."""
    stand_in = "''" if isinstance(dtype, TEXTS) else "'1970-01-01'" if isinstance(dtype, DATES) else "0"
    typed = f"CAST({stand_in} AS {dtype.simpleString()})"
    return [f"coalesce({without_nan(x, dtype)}, {typed})", missing(x, dtype)]


def _canonical_key(x, dtype):
    return f"coalesce({canon(x, dtype)}, '~')"


def join_keys(source, target, keys, mode="canonical"):
    """Plain equality columns `__k..` for both sides, never null.

    Keys of one type compare as stored. Keys of different types compare by
    value (text '1' meets number 1) or, with mode 'strict', never meet unless
    both are numbers. Because the columns are never null, joins and groupings
    on them share one partitioning.
    """
    s_exprs, t_exprs = [], []
    for k in keys:
        s, t = source.schema[k].dataType, target.schema[k].dataType
        if _is_native(s, t):
            s_exprs += _native_key(name(k), s)
            t_exprs += _native_key(name(k), t)
        elif mode == "strict" and type_class(s) != type_class(t):
            s_exprs.append(f"concat('source ', {_canonical_key(name(k), s)})")
            t_exprs.append(f"concat('target ', {_canonical_key(name(k), t)})")
        else:
            s_exprs.append(_canonical_key(name(k), s))
            t_exprs.append(_canonical_key(name(k), t))
    named = lambda exprs: [F.expr(e).alias(f"__k{i}") for i, e in enumerate(exprs)]
    return named(s_exprs), named(t_exprs)


def names_of(key_columns):
    return [f"__k{i}" for i in range(len(key_columns))]


def distinct_keys(df, keys):
    return df.select(*keys).distinct()


def _is_native(s_type, t_type):
    return s_type == t_type and isinstance(s_type, (*TEXTS, *DATES, T.NumericType, T.BooleanType))


def _restored(df, other, keys):
    """{key: its value put together again from the key columns}, for the keys that compare as stored."""
    out, i = {}, 0
    for k in keys:
        native = _is_native(df.schema[k].dataType, other.schema[k].dataType)
        if native:
            out[k] = f"if(__k{i + 1}, NULL, __k{i})"
        i += 2 if native else 1
    return out


def one_per_key(df, key_columns, prefix, restored):
    """One row per key: `<prefix>` the smallest whole row, `<prefix>_n` the row count.

    Keys that the key columns hold unchanged do not travel twice.
    """
    names = names_of(key_columns)
    carried = [c for c in df.columns if c not in restored] or df.columns[:1]
    least = (
        df.select(*key_columns, F.struct(*[name(c) for c in carried]).alias("row"))
        .groupBy(*names).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias(prefix + "_n"))
    )
    whole = ", ".join(f"{restored.get(c, name('row', c))} AS {name(c)}" for c in df.columns)
    return least.selectExpr(*names, f"struct({whole}) AS {prefix}", prefix + "_n")


def first_per_key(df, keys):
    """The smallest row, by all columns in order, of every key; null is a key of its own.

    A narrow pass finds the keys that several rows have. A Bloom filter of these
    parts the rows: one that fails it is alone with its key and stays as it is,
    the others are reduced to one a key. So unique rows are neither sorted nor
    shuffled; with more repeated keys than the filter holds, all are reduced.
    """
    df = atomic_frame(df)
    own, _ = join_keys(df, df, keys)
    names, columns = names_of(own), [name(c) for c in df.columns]
    several = written(df.select(*own).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "keys")
    n = several.count()
    if not n:
        return df
    filter_ = bloom_filter(several, names, n)
    if filter_ is None:
        return one_per_key(df, own, "row", _restored(df, df, keys)).select("row.*")
    part = lambda how: bloom_join(df, own, filter_, how).select(*columns)
    return part("left_anti").unionByName(one_per_key(part("left_semi"), own, "row", _restored(df, df, keys)).select("row.*"))


@dataclass
class Pair:
    """Two datasets joined on their keys, one row per key and side.

    `frame` has the key columns, the rows `s` and `t` (null where a side lacks
    the key) and the row counts `s_n` and `t_n`.
    """

    frame: object
    keys: list
    key_names: list
    columns: list
    s_schema: T.StructType
    t_schema: T.StructType

    def s_type(self, column):
        return self.s_schema[column].dataType

    def t_type(self, column):
        return self.t_schema[column].dataType

    def key_text(self):
        side = lambda p, schema: format_key([(k, name(p, k), schema[k].dataType) for k in self.keys])
        return f"if(s IS NOT NULL, {side('s', self.s_schema)}, {side('t', self.t_schema)})"

    def matched(self):
        return self.frame.where("s IS NOT NULL AND t IS NOT NULL")


def key_pair(source, target, keys, mode="canonical", how="full_outer"):
    """Join two datasets on their keys after reducing each side to one row per key."""
    source, target = atomic_frame(source), atomic_frame(target)
    s_keys, t_keys = join_keys(source, target, keys, mode)
    names = names_of(s_keys)
    kept = _restored(source, target, keys)
    frame = one_per_key(source, s_keys, "s", kept).join(one_per_key(target, t_keys, "t", kept), names, how)
    columns = sorted(set(source.columns) & set(target.columns))
    return Pair(frame, list(keys), names, columns, source.schema, target.schema)


def key_sets(source, target, keys, mode="canonical"):
    """Full outer join of the two key sets: key columns, `s_n`, `t_n` (null where absent).

    Made by one aggregate over the keys of both sides, so no task holds a key
    twice or sorts it.
    """
    s_keys, t_keys = join_keys(source, target, keys, mode)
    both = source.select(*s_keys, F.lit(True).alias("__s")).union(target.select(*t_keys, F.lit(False).alias("__s")))
    count = lambda test, n: F.nullif(F.count_if(test), F.lit(0).cast("bigint")).alias(n)
    return both.groupBy(*names_of(s_keys)).agg(count(F.col("__s"), "s_n"), count(~F.col("__s"), "t_n"))


def key_match(sets):
    """Common, source-only and target-only key counts, from `key_sets` or a `Pair` frame."""
    s, t = F.col("s_n").isNotNull(), F.col("t_n").isNotNull()
    return sets.agg(
        F.count_if(s & t).alias("common"),
        F.count_if(s & ~t).alias("source_only"),
        F.count_if(t & ~s).alias("target_only"),
    )


def symmetric_difference(sets):
    m = key_match(sets)
    return m.select("source_only", "target_only",
                    (F.col("source_only") + F.col("target_only")).alias("difference"))


def _distinct_against(df, other, keys, mode, how):
    """Distinct keys of `df`, joined to the distinct keys of `other`; repeated keys are combined before the shuffle."""
    mine, theirs = join_keys(df, other, keys, mode)
    names = names_of(mine)
    left = df.select(*mine, *[df[k] for k in keys]).groupBy(*names).agg(*[F.min(k).alias(k) for k in keys])
    return left.join(other.select(*theirs).distinct(), names, how).select(*keys)


def missing_keys(df, other, keys, mode="canonical"):
    """Distinct keys of `df` that `other` lacks."""
    return _distinct_against(df, other, keys, mode, "left_anti")


def key_intersection(source, target, keys, mode="canonical"):
    """Distinct keys found on both sides (null meets null)."""
    return _distinct_against(source, target, keys, mode, "left_semi")


def key_difference(source, target, keys, mode="canonical"):
    return missing_keys(source, target, keys, mode)


def count_up(df, start, n, number, chunk=100_000):
    """One row per number from `start` on, `n` (at least 1) of them.

    A row with a large `n` is first cut into pieces that spread over the tasks.
    """
    numbers = lambda rows, first, count: rows.withColumn(
        number, F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1)))
    few = numbers(df.where(F.col(n) <= chunk), start, n).select(*df.columns, number)
    many = df.where(F.col(n) > chunk)
    pieces = many.withColumn("__piece", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / chunk)))).withColumn(
        "__first", F.col(start) + F.col("__piece") * chunk).withColumn(
        "__count", F.least(F.lit(chunk), F.col(n) - F.col("__piece") * chunk))
    spread = pieces.repartition("__first", "__piece")
    return few.unionByName(numbers(spread, "__first", "__count").select(*df.columns, number))


def row_surplus(source, target):
    """Whole rows that `source` has more often than `target`, with the `surplus`."""
    columns = sorted(set(source.columns) & set(target.columns))
    signed = lambda df, n: df.select(*columns, F.lit(n).alias("n"))
    return (signed(source, 1).unionByName(signed(target, -1)).groupBy(*columns)
            .agg(F.sum("n").alias("surplus")).where("surplus > 0"))


def row_difference(source, target):
    """Whole rows of `source` beyond their number in `target`, each as often as it is in excess."""
    surplus = row_surplus(atomic_frame(source), atomic_frame(target)).withColumn("__one", F.lit(1).cast("bigint"))
    return count_up(surplus, "__one", "surplus", "__copy").drop("surplus", "__one", "__copy")


def duplicates(df, keys):
    """Keys with more than one row and their row count."""
    plain = df.selectExpr(*[f"{without_nan(name(k), df.schema[k].dataType)} AS {name(k)}" for k in keys])
    return plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def first_n(df, order, n, partition=None):
    """The first n rows in a given order, per partition value if one is named.

    With a partition the row-number limit is applied inside every task before
    the shuffle, so a large group moves n rows per task at most.
    """
    if partition is None:
        return df.orderBy(*order).limit(n)
    partition = [partition] if isinstance(partition, str) else partition
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n)


def hot_keys(df, key_columns):
    """(hashes of the keys that hold a large share of the rows, number of rows), from one mergeable sketch."""
    found = (
        df.select(F.xxhash64(*key_columns).alias("h"))
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_TRACKED // 2}, {HOT_TRACKED * 10})").alias("top"))
        .first()
    )
    limit = max(found.n * HOT_SHARE, HOT_ROWS)
    return [item["item"] for item in found.top or [] if item["count"] > limit], found.n


def hot_key_hashes(df, key_columns):
    return hot_keys(df, key_columns)[0]


def keep_keys(df, keys_df, keys, mode="canonical", how="left_semi", split_hot=True):
    """Rows of `df` whose key is in `keys_df` (or, with 'left_anti', is not)."""
    mine, theirs = join_keys(df, keys_df, keys, mode)
    return keep_key_columns(df, mine, keys_df.select(*theirs).distinct(), how, split_hot)


def keep_key_columns(df, key_columns, right, how="left_semi", split_hot=True):
    """Rows of `df` whose key columns are among the distinct rows of `right`.

    Rows of heavy keys do not shuffle: the few keys concerned (at most
    1 / HOT_SHARE of them) are broadcast to where the rows are. Everything else
    is a normal shuffled join, of PART_ROWS rows a task where `df` is large.
    """
    names, columns = names_of(key_columns), [name(c) for c in df.columns]
    left = df.select(*columns, *key_columns)
    hot, n = hot_keys(df, key_columns) if split_hot else ([], 0)
    join = lambda rows, among: _cut(rows, among, names, how, n).select(*columns)
    if not hot:
        return join(left, right)
    is_hot = F.xxhash64(*[F.col(n) for n in names]).isin(hot)
    heavy = left.where(is_hot).join(F.broadcast(right.where(is_hot)), names, how)
    return heavy.select(*columns).unionByName(join(left.where(~is_hot), right.where(~is_hot)))


def _cut(left, right, names, how, rows):
    """`left` joined to the distinct rows of `right`; `rows` is about the size of `left`.

    Spark sizes a join's parts by their compressed bytes, which say little about
    the memory that sorting them takes. So a large frame is dealt out by rows,
    and joined 'inner', which the distinct rows allow and which, unlike
    'left_semi', is not pushed below the dealing out.
    """
    parts = math.ceil(rows / PART_ROWS)
    if how != "left_semi" or parts <= left.sparkSession.sparkContext.defaultParallelism:
        return left.join(right, names, how)
    small = right.limit(ONE_TASK + 1).count() <= ONE_TASK
    if small:
        return left.join(F.broadcast(right), names, how)  # at most ONE_TASK rows
    return left.repartition(parts, *names).join(right.repartition(parts, *names), names)


def salted_left_join(df, other, key):
    """`df` with the columns of the rows of `other` that have its key, null without one.

    Rows of heavy keys are dealt over SALTS parts, and the rows of `other` with
    these keys (at most 1 / HOT_SHARE keys) are repeated once a part.
    """
    hot = hot_key_hashes(df, [F.col(key)])
    if not hot:
        return df.join(other, key, "left")
    heavy = F.xxhash64(key).isin(hot)
    dealt = df.withColumn("__salt", F.when(heavy, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    parts = F.when(F.xxhash64(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(other.withColumn("__salt", F.explode(parts)), [key, "__salt"], "left").drop("__salt")


def broadcast_if_small(df, rows=100_000):
    """The frame marked for broadcast if a bounded count proves it small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sample_keys(df, keys, n, seed=42):
    """n distinct keys, those with the smallest seeded hashes: the same ones however the data is partitioned.

    Up to ONE_TASK keys are picked by a plain ordered limit. More are cut by a
    bound that an estimate of the number of keys gives, with a margin, and among
    the few left by the exact hash of the last one; a bound that was too low is
    raised. So no task ever holds n keys.
    """
    own = distinct_keys(df, keys)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(own[k].cast("string"), F.lit("~")) for k in keys]))
    if n <= ONE_TASK:
        return own.orderBy(order.cast("binary"), *keys).limit(n)
    hashed = own.withColumn("__order", order).withColumn("__h", F.conv(F.substring("__order", 1, 15), 16, 10).cast("bigint"))
    several = df.agg(F.approx_count_distinct(F.struct(*keys)).alias("d")).first()["d"]
    share = (1.2 * n + 8 * math.sqrt(n)) / max(several, 1)
    while True:
        left = written(hashed.where(F.col("__h") < int(share * HASHES)) if share < 1 else hashed, "picked")
        ends = left.agg(F.min("__h").alias("low"), F.max("__h").alias("high"), F.count("__h").alias("n")).first()
        if ends.n >= n or share >= 1:
            break
        share *= 2
    if ends.n <= n:
        return left.select(*keys)
    last, _ = around_rank(left, "__h", n - 1, ends)
    before = left.where(F.col("__h") < last)
    tied = left.where(F.col("__h") == last).orderBy(F.col("__order").cast("binary"), *keys).limit(n - before.count())
    return before.select(*keys).unionByName(tied.select(*keys))  # hardly ever more than one row is tied


def smaller_side(source_rows, target_rows):
    """Which side must be cut down: the larger one, none if they are equal."""
    if source_rows == target_rows:
        return None
    return "target" if source_rows < target_rows else "source"


def subset_pair(source, target, keys, mode="canonical"):
    """Cut the larger side to the keys of the smaller one.

    Returns (source, target, applied). Nothing is cut if the sizes are equal
    or no key would be left.
    """
    from twinframe.operators.profile import record_counts
    side = smaller_side(*record_counts(source, target).first()[:2])
    if side is None:
        return source, target, False
    larger, smaller = (target, source) if side == "target" else (source, target)
    cut = keep_keys(larger, smaller, keys, mode)
    if cut.isEmpty():
        return source, target, False
    return (source, cut, True) if side == "target" else (cut, target, True)
