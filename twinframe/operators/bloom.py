"""A Bloom filter of keys as a small table: built by an aggregate that tasks combine, tested by a broadcast join."""

from pyspark.sql import functions as F

from twinframe.functions.values import name

#: Bits a key and most 64-bit words of a filter, which is broadcast. With under half the bits a key there is none.
BITS, WORDS = 12, 1 << 19


def key_bits(columns, words):
    """(number of the 64-bit word, mask of up to four bits in it) of key columns."""
    h = F.xxhash64(*columns)
    more = F.xxhash64(h, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        place = F.pmod(F.shiftright(more, 8 * i), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return F.pmod(h, F.lit(words)), mask


def bloom_filter(keys, names, n):
    """(table of word and bits, number of words) for n rows of key columns; None if it would let nearly all pass."""
    words = 1 << 10
    while words * 64 < n * BITS and words < WORDS:
        words *= 2
    if words * 64 * 2 < n * BITS:
        return None
    at, mask = key_bits(names, words)
    return keys.select(at.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits")), words


def bloom_join(df, key_columns, filter_, how):
    """The rows of `df` whose key columns may be in the filter ('left_semi'), or are surely not ('left_anti')."""
    bits, words = filter_
    columns = [name(c) for c in df.columns]
    at, mask = key_bits([f"__k{i}" for i in range(len(key_columns))], words)
    tested = df.select(*columns, *key_columns).withColumn("__at", at).withColumn("__mask", mask)
    passes = (F.col("__at") == F.col("__word")) & (F.col("__mask").bitwiseAND(F.col("__bits")) == F.col("__mask"))
    return tested.join(F.broadcast(bits), passes, how).select(*columns)  # at most WORDS rows
