"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words of which a fixed mask ignores some places. The
masks are such that every window of WINDOW words with at most SUBSTITUTIONS
replaced words contains an equal seed. Seeds of benchmark and documents are
joined on their hashes; around each hit the words are compared one by one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.text import ROOT, chunks, mix, words
from twinframe.shared import written

WINDOW, SUBSTITUTIONS, SHORTEST = 13, 2, 5
#: Places that count. Each two replaced words of 13 leave a seed of one mask whole (tests/llm proves it).
MASKS = ((0, 1, 3, 8, 9, 10), (0, 1, 2, 4, 5, 6))
BEFORE = WINDOW - min(max(m) + 1 for m in MASKS)
AROUND = BEFORE + WINDOW
#: Size of the filter that documents pass before the join: 4 MB, whatever the benchmark's size.
FILTER_BITS = 25


def seed_hashes(word, places, salt):
    n = max(len(word) - max(places), 0)
    out = np.full(n, salt, np.uint64)
    for p in places:
        out = mix(out * ROOT + word[p:p + n])
    return out


def seeds(column, lengths, passes):
    """(row, position, word count or 0, hash, words around) of the seeds of an Arrow text column.

    Rows with fewer than WINDOW words are one seed of all their words if
    `lengths` is None (benchmark); documents look for runs of those lengths.
    `passes` tells which hashes to keep.
    """
    for first, data, offsets in chunks(column, 1 << 19):
        word, at = words(data, offsets)
        count = np.diff(at)
        owner = np.repeat(np.arange(len(count)), count)
        found = []
        for salt, places in enumerate(MASKS):
            hashes = seed_hashes(word, places, salt + 1)
            start = np.arange(len(hashes))
            whole = start + max(places) < at[owner[:len(hashes)] + 1]
            if lengths is None:
                whole &= count[owner[:len(hashes)]] >= WINDOW
            found.append((start, hashes, whole, 0))
        for n in range(SHORTEST, WINDOW) if lengths is None else lengths:
            hashes = seed_hashes(word, range(n), 100 + n)
            start = np.arange(len(hashes))
            whole = start + n <= at[owner[:len(hashes)] + 1]
            if lengths is None:
                whole &= count[owner[:len(hashes)]] == n
            found.append((start, hashes, whole, n))
        padded = np.concatenate([np.zeros(BEFORE, np.uint64), word, np.zeros(AROUND, np.uint64)])
        for start, hashes, whole, n in found:
            keep = np.flatnonzero(whole & passes(hashes))
            if not len(keep):
                continue
            at_word = start[keep]
            row = owner[at_word]
            around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at_word].copy()
            place = at_word[:, None] + np.arange(-BEFORE, AROUND - BEFORE)
            around[(place < at[row][:, None]) | (place >= at[row + 1][:, None])] = 0
            yield row + first, at_word - at[row], np.full(len(keep), n, np.int32), hashes[keep], around


def seed_rows(frame, key, lengths, bits=None):
    """id, key, position, words, around of the seeds of a frame's texts; `bits`: broadcast filter."""
    def passes(hashes):
        if bits is None:
            return np.ones(len(hashes), bool)
        table = bits.value
        mask = np.uint64((1 << FILTER_BITS) - 1)
        out = np.ones(len(hashes), bool)
        for shift in (0, 32):
            place = (hashes >> np.uint64(shift)) & mask
            out &= (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    names = ["id", "key", "position", "words", "around"]

    def run(batches):
        for batch in batches:
            ids = batch.column(key)
            for row, position, n, hashes, around in seeds(batch.column("text"), lengths, passes):
                for at in range(0, len(row), 8192):
                    part = slice(at, at + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[part])), pa.array(hashes[part].view(np.int64)),
                         pa.array(position[part].astype(np.int32)), pa.array(n[part]),
                         pa.array([x.tobytes() for x in around[part]], pa.binary())], names)

    return frame.select(key, "text").mapInArrow(run, "id long, key long, position int, words int, around binary")


def filter_bits(tests):
    """The filter as bytes: at most 2^FILTER_BITS bits reach the driver, however many seeds there are."""
    words64 = (tests.select(F.explode(F.array("key", F.shiftright("key", 32))).alias("place"))
               .select(F.col("place").bitwiseAND((1 << FILTER_BITS) - 1).alias("place"))
               .select(F.shiftright("place", 5).alias("word"),
                       F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
               .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[words64["word"].to_numpy(int)] = words64["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def overlaps(docs, benchmark):
    """doc_id, item_id, position, at: the windows of documents that verified benchmark windows cover.

    A window has WINDOW words of which at most SUBSTITUTIONS differ; items with
    SHORTEST to 12 words count where all their words occur in a row.
    """
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    tests = written(seed_rows(bench, "item_id", None), "tests")
    spark = docs.sparkSession
    lengths = [r["words"] for r in tests.where("words > 0").select("words").distinct().collect()]  # at most 8 numbers
    bits = spark.sparkContext.broadcast(filter_bits(tests))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    hits = seed_rows(docs, "doc_id", sorted(lengths), bits)
    paired = hits.join(tests.select("key", F.col("id").alias("item_id"), F.col("around").alias("test"),
                                    F.col("position").alias("at")), "key")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(-1, AROUND)
                        for c in ("around", "test"))
                equal = np.concatenate([np.zeros((len(a), 1), int), ((a == b) & (a != 0)).cumsum(1)], 1)
                n = part.column("words").to_numpy(zero_copy_only=False)
                whole = np.concatenate([np.zeros((len(a), 1), int), (a != 0).cumsum(1)], 1)
                tests = np.concatenate([np.zeros((len(a), 1), int), (b != 0).cumsum(1)], 1)
                for begin in range(BEFORE + 1):
                    end = begin + WINDOW
                    full = ((whole[:, end] - whole[:, begin] == WINDOW) & (tests[:, end] - tests[:, begin] == WINDOW))
                    good = (n == 0) & full & (equal[:, end] - equal[:, begin] >= WINDOW - SUBSTITUTIONS)
                    if begin == BEFORE:
                        good |= (n > 0) & (equal[np.arange(len(a)), BEFORE + np.minimum(n, WINDOW)] - equal[:, BEFORE] == n)
                    keep = np.flatnonzero(good)
                    if len(keep):
                        take = pa.array(keep)
                        move = begin - BEFORE
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(take), part.column("item_id").take(take),
                             pa.array(part.column("position").to_numpy(zero_copy_only=False)[keep] + np.int32(move)),
                             pa.array(part.column("at").to_numpy(zero_copy_only=False)[keep] + np.int32(move))],
                            ["doc_id", "item_id", "position", "at"])

    return paired.mapInArrow(run, "doc_id long, item_id long, position int, at int").distinct()


def contamination(docs, benchmark):
    """doc_id, contaminated, n_windows, n_items, items of every row of documents (integer doc_id, text).

    `items` holds the benchmark items, ascending, that some verified window of
    the document covers; `n_windows` counts the document's such windows.

    Defined results: words are lower-cased and parted by ASCII white space;
    null and empty texts hold no words and are clean, as is any document
    without a doc_id. Items with fewer than SHORTEST words, null items and
    items without an id match nothing; repeated items change nothing. Rows of
    one doc_id share their windows. Other columns are passed over.
    """
    found = overlaps(docs, benchmark)
    items = (found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
             .groupBy("doc_id").agg(F.sum("n").alias("n_windows"), F.array_sort(F.collect_list("item_id")).alias("items")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return (ids.join(items, "doc_id", "left")
            .select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                    F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
                    F.coalesce(F.expr("cardinality(items)"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<bigint>")).alias("items")))
