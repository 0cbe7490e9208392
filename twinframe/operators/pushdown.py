"""The keys of one dataset as filters of another, ahead of any shuffle.

A short list of keys becomes literal predicates, which reach the scan. A longer
one becomes the range of each key column, which reaches the scan as well, and a
Bloom filter, an aggregate that tasks combine, tested where the rows are read.
What passes is joined exactly.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.types import TEXTS
from twinframe.functions.values import missing, name, without_nan
from twinframe.operators.bloom import bloom_filter, bloom_join
from twinframe.operators.keys import join_keys, keep_keys, names_of
from twinframe.shared import written

#: Keys sent as a literal list.
IN_LIST = 1000
#: The number of a date or time, and back.
NUMBERS = {T.DateType: ("unix_date", F.date_from_unix_date), T.TimestampType: ("unix_micros", F.timestamp_micros)}
LITERALS = (*TEXTS, T.IntegralType, T.DecimalType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.BooleanType)


def _portable(x, dtype):
    """SQL of a key value as the driver gets it, null for NaN; dates and times as numbers, free of calendars and time zones."""
    x = without_nan(x, dtype)
    return f"{NUMBERS[type(dtype)][0]}({x})" if type(dtype) in NUMBERS else x


def _literal(value, dtype):
    return NUMBERS[type(dtype)][1](F.lit(value)) if type(dtype) in NUMBERS else F.lit(value).cast(dtype)


def _comparable(df, keys_df, keys):
    """The keys whose column has one type on both sides, of a kind that literals can hold."""
    return [k for k in keys if df.schema[k].dataType == keys_df.schema[k].dataType and isinstance(df.schema[k].dataType, LITERALS)]


def list_predicate(df, keys_df, keys):
    """A predicate for each comparable key column: its values are among those of `keys_df`, which is short.

    Null and NaN are one value. With one key column the predicate is the whole truth.
    """
    usable = _comparable(df, keys_df, keys)
    rows = keys_df.selectExpr(*[f"{_portable(name(k), df.schema[k].dataType)} AS {name(k)}" for k in usable]).collect() if usable else []
    out = F.lit(True)
    for i, k in enumerate(usable):
        dtype, values = df.schema[k].dataType, {r[i] for r in rows}
        found = F.col(name(k)).isin([_literal(v, dtype) for v in sorted(values - {None})])
        out = out & (found | F.expr(missing(name(k), dtype)) if None in values else found)
    return out


def range_predicate(df, keys_df, keys):
    """A predicate for each comparable key column: its values lie between the least and greatest of `keys_df`, or are null if one is."""
    usable = _comparable(df, keys_df, keys)
    if not usable:
        return F.lit(True)
    ends = []
    for k in usable:
        x = _portable(name(k), df.schema[k].dataType)
        ends += [f"min({x})", f"max({x})", f"count_if({missing(name(k), df.schema[k].dataType)}) > 0"]
    row, out = keys_df.selectExpr(*ends).first(), F.lit(True)
    for i, k in enumerate(usable):
        (low, high, null), dtype = row[3 * i:3 * i + 3], df.schema[k].dataType
        inside = F.lit(False) if low is None else F.col(name(k)).between(_literal(low, dtype), _literal(high, dtype))
        out = out & (inside | F.expr(missing(name(k), dtype)) if null else inside)
    return out


def keep_pushed_keys(df, keys_df, keys, target_keys=None, mode="canonical"):
    """Rows of `df` whose key occurs in `keys_df`, filtered as early as the number of keys allows.

    Null meets null, NaN counts as null. Key columns of different types compare
    as in `join_keys`; only the Bloom filter sees those. The distinct keys are
    written once.
    """
    target_keys = target_keys or keys
    renamed = keys_df.select(*[F.col(name(k)).alias(t) for k, t in zip(keys, target_keys)])
    wanted = written(renamed.distinct(), "keys")
    n = wanted.count()
    mine, theirs = join_keys(df, wanted, target_keys, mode)
    names = names_of(mine)
    left = lambda rows: rows.select(*[rows[name(c)] for c in rows.columns], *mine)
    if n <= IN_LIST:
        narrow = df.where(list_predicate(df, wanted, target_keys))
        if len(target_keys) == 1 and _comparable(df, wanted, target_keys):
            return narrow
        few = F.broadcast(wanted.select(*theirs).distinct())  # at most IN_LIST rows
        return left(narrow).join(few, names, "left_semi").select(*[name(c) for c in df.columns])
    narrow = df.where(range_predicate(df, wanted, target_keys))
    filter_ = bloom_filter(wanted.select(*theirs), names, n)
    if filter_:
        narrow = bloom_join(narrow, mine, filter_, "left_semi")
    return keep_keys(narrow, wanted, target_keys, mode)
