"""Periodic runs of words, found online by catchers over completed power-of-two blocks.

A text is a stream of words, appended piece by piece. For every size 1, 2, 4,
... the completed blocks of so many words have catchers. A catcher waits for
its block to come again 2 * size - 1 to 4 * size - 2 words later, so each
appended word has its suffix of that size compared with the two blocks in
reach. A catch is part of a square whose half is the distance of the two; every
square is caught, because its first half holds a whole block of the size
responsible for its length. Catches of consecutive blocks at one distance merge
into one run, whose ends are then settled word by word. A step is done for all
words of a piece at once, in numpy; work is words * log(words).
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.text import ROOT, chunks, mix
from twinframe.shared import spread

#: Plan settings only: bytes of text handled together and words appended together.
TOGETHER = 8 << 20
PIECE = 1 << 15

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Catchers:
    """The catchers of one block size. Block hashes further back than they reach are dropped."""

    def __init__(self, size):
        self.size, self.first, self.hashes = size, 0, np.zeros(0, np.uint64)
        self.shifts, self.blocks = [], []

    @property
    def end(self):
        return self.first + len(self.hashes)

    def append(self, new):
        """Compare the windows of `size` words that have just become complete, given by their hashes."""
        size, old = self.size, self.end
        keep = max(len(self.hashes) - 4 * size, 0)
        self.first, self.hashes = self.first + keep, np.concatenate([self.hashes[keep:], new])
        least = 2 * size - 1
        for back in (0, size):
            window = np.arange(max(old, least + back), self.end)
            block = (window - least) // size * size - back
            hit = np.flatnonzero(self.hashes[window - self.first] == self.hashes[block - self.first])
            self.blocks.append(block[hit])
            self.shifts.append(window[hit] - block[hit])

    def chains(self):
        """(distance, first block, last block) of the catches of consecutive blocks at one distance."""
        shift, block = np.concatenate(self.shifts), np.concatenate(self.blocks)
        order = np.lexsort((block, shift))
        shift, block = shift[order], block[order]
        starts = np.ones(len(shift), bool)
        starts[1:] = (np.diff(shift) != 0) | (np.diff(block) != self.size)
        ends = np.roll(starts, -1)
        return shift[starts], block[starts], block[ends]


class Stream:
    """Words given as numbers, appended piece by piece; `runs` tells the runs so far."""

    def __init__(self, exponent, min_words, longest):
        self.exponent, self.min_words, self.words = exponent, min_words, [np.zeros(0, np.int64)]
        self.levels = [Catchers(1 << k) for k in range(levels(longest, exponent, min_words))]

    def append(self, words):
        self.words.append(words)
        new = mix((words.astype(np.uint64) + np.uint64(1)) * ROOT)
        for level, above in zip(self.levels, [*self.levels[1:], None]):
            level.append(new)
            if above is not None:
                left = level.hashes[above.end - level.first:max(level.end - level.size, above.end) - level.first]
                right = level.hashes[above.end + level.size - level.first:][:len(left)]
                new = mix(mix(left) * ROOT + right)

    def runs(self):
        """{(start, length): period} of all runs."""
        words, found, sure = np.concatenate(self.words), {}, Cover()
        for level in self.levels:
            shift, first, last = level.chains()
            # a run of this distance has so many equal pairs of words, of which a chain's blocks miss size - 1 at either end
            enough = last - first + 3 * level.size - 2 >= np.maximum((self.exponent - 1) * shift, self.min_words - shift)
            shift, first, last = shift[enough], first[enough], last[enough]
            new = ~sure.holds(first, last + level.size + shift, shift)
            for q, a, z in zip(shift[new].tolist(), first[new].tolist(), last[new].tolist()):
                for run in self.settle(words, q, max(a - level.size + 1, 0), z + 2 * level.size - 1):
                    found[run] = min(found.get(run, q), q)
            sure = Cover(found)
        return found

    def settle(self, words, q, low, high):
        """(start, length) of the runs of distance q whose equal pairs begin at low to high, by comparing the words."""
        high = min(high, len(words) - q)
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = words[low:high] == words[low + q:high + q]
        edge = np.flatnonzero(np.diff(same))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - a + q >= max(self.min_words, self.exponent * q):
                yield low + a, z - a + q


class Cover:
    """Runs already known, which hold chains of their periods' multiples; these are no runs of their own."""

    def __init__(self, found=()):
        runs = sorted((start, start + length, found[start, length]) for start, length in found)
        self.start, self.end, self.period = (np.array([r[i] for r in runs], np.int64) for i in range(3))
        self.furthest = np.zeros(len(runs), np.int64)
        for i in range(1, len(runs)):
            last = self.furthest[i - 1]
            self.furthest[i] = i if self.end[i] > self.end[last] else last

    def holds(self, start, end, shift):
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        run = self.furthest[np.maximum(at, 0)]
        return (at >= 0) & (self.end[run] >= end) & (shift % self.period[run] == 0)


def levels(n, exponent, min_words):
    """How many block sizes n words need: the size 2^k sees periods from 2 * 2^k - 1 on."""
    k = 0
    while max(min_words, exponent * ((2 << k) - 1)) <= n:
        k += 1
    return k


def runs_of(texts, exponent, min_words):
    """For every list of words its runs (start, length, period), by start, then period.

    Texts that need equally many block sizes make one stream, parted by words of their own.
    """
    out, alike, number = [[] for _ in texts], defaultdict(list), defaultdict()
    number.default_factory = number.__len__
    for i, words in enumerate(texts):
        alike[levels(len(words), exponent, min_words)].append(i)
    for depth, members in alike.items():
        if not depth:
            continue
        stream = Stream(exponent, min_words, max(len(texts[i]) for i in members))
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in members])
        numbers = np.empty(starts[-1], np.int64)
        for start, i in zip(starts, members):
            numbers[start:start + len(texts[i])] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
            numbers[start + len(texts[i])] = -2 - i
        for at in range(0, len(numbers), PIECE):
            stream.append(numbers[at:at + PIECE])
        for (start, length), period in stream.runs().items():
            member = int(np.searchsorted(starts, start, "right")) - 1
            out[members[member]].append((start - int(starts[member]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words, runs):
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def periodic_runs(docs, exponent=4, min_words=6):
    """doc_id, runs (start, length, period in words), collapsed (the text without repetitions) of every document.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of consecutive words of
    smallest period q and of at least max(min_words, exponent * q) words that
    cannot be made longer with that period. The collapsed text keeps the first
    q words of each run; words are joined by one space.

    Defined results: null and empty texts, and texts without words, have no run
    and an empty collapsed text. Every row counts for itself, so repeated rows
    and null or equal doc_ids give a row each. Texts may be of any length that
    fits one task. No documents give no rows. Other columns are passed over.
    """
    assert exponent >= 2 and min_words >= 2

    def find(batches):
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), TOGETHER):
                texts = [data[a:z].tobytes().split() for a, z in zip(offsets, offsets[1:])]
                found = runs_of(texts, exponent, min_words)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found],
                                pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                short = pa.array([collapse(words, r) for words, r in zip(texts, found)], pa.large_binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), runs, short.cast(pa.binary())], ["doc_id", "runs", "collapsed"])

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return (rows.mapInArrow(find, f"doc_id bigint, runs {RUNS}, collapsed binary")
            .withColumn("collapsed", F.col("collapsed").cast("string")))


def planted(docs):
    """The documents with a period planted: where crc32 of the decimal doc_id ends in 0, from one word on the p words repeat.

    A null doc_id leaves the text as it is.
    """
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def run_digests(found):
    """The columns of op11 from those of `periodic_runs`."""
    def stronger(x, y):
        """Descending length / period, compared exactly; then by start and period."""
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(left != right, F.when(left > right, -1).otherwise(1))
                .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
                .otherwise(F.signum(x["period"] - y["period"]).cast("int")))
    best = F.get(F.array_sort("runs", stronger), 0)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
