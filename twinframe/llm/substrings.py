"""Exact removal of repeated 100-byte strings with a sparse suffix array.

Every LENGTH-byte window has an anchor, the place of its smallest GRAM-byte
hash; neighbouring windows share it, and equal windows have equal anchors at
equal offsets. So only the suffixes at anchors are sorted, each standing for its
run of windows (a segment). Splitters sampled from the suffixes' leading bytes
deal them over ranges; in each range equal segments meet, and all but the first
of them repeat. Segments that share an anchor's gram but not all bytes are cut
out of the texts, and their windows are sorted by multikey quicksort. Grams of
very many different segments are resolved window by window across all ranges.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.text import CHUNK, ROOT, chunks, inverse_powers, mix, powers
from twinframe.shared import written

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
PLACE = np.uint64((1 << 28) - 1)
LOWEST = -(1 << 63)
#: A number for each byte, for the second hash of a class.
SECOND = np.random.default_rng(21).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Plan settings only: documents sampled for splitters; segments of one gram that one task sorts; windows sorted at once.
SAMPLED, HOT, TOGETHER = 2000, 2000, 200_000
ROW = "bucket int, gram long, class long, more long, doc long, start long, m int, kind int"


def window_hashes(data):
    """Hashes of all 32-byte and all 64-byte windows."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    for s in (1, 2, 4, 8, 16):
        h = mix(h[:-s] * ROOT + h[s:])
    return h, mix(h[:-32] * ROOT + h[32:])


def segments(data, offsets):
    """(row, first window, number of windows, anchor, gram hash, class hash, second class hash) of runs of windows with one anchor."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    small, large = window_hashes(data)
    low = (small & ~PLACE) | np.arange(len(small), dtype=np.uint64)
    wide = 1
    while 2 * wide <= REACH:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    low = np.minimum(low[:len(low) - (REACH - wide)], low[REACH - wide:])
    anchor = (low & PLACE).astype(np.int64)
    window = np.arange(n - LENGTH + 1)
    row = np.searchsorted(offsets, window, "right") - 1
    keep = window + LENGTH <= offsets[row + 1]
    window, row, anchor = window[keep], row[keep], anchor[keep]
    if not len(window):
        return (window,) * 4 + (np.zeros(0, np.uint64),) * 3
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    m = np.diff(np.append(at, len(window)))
    first, anchor, row = window[at], anchor[at], row[at]
    rest, gram = LENGTH + m - 1 - 64, small[anchor]
    kind = mix(large[first] * ROOT + (m + (anchor - first) * 1000).astype(np.uint64))
    kind = mix(mix(kind * ROOT + large[first + rest // 2]) * ROOT + large[first + rest])
    del small, large, low, window, new, keep
    # over each byte of the run, and from other numbers than the first hash
    total = powers(n + 1)
    total[1:] = total[:-1]
    total[0] = 0
    total[1:] *= SECOND[data]
    np.cumsum(total, out=total)
    more = mix((total[first + LENGTH + m - 1] - total[first]) * inverse_powers(n)[first])
    return row, first, m, anchor, gram, kind, more


def leads(data, places):
    """The eight bytes from each place on, as numbers in byte order."""
    out = np.zeros(len(places), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[places + i]
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def splitters(docs, buckets):
    """Leading bytes that part the suffixes into about `buckets` ranges, from a sample of documents picked by hash."""
    total = docs.count()
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLED))) == 0) if total else docs

    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), CHUNK // 2):
                yield pa.RecordBatch.from_arrays([pa.array(leads(data, segments(data, offsets)[3]))], ["lead"])

    cuts = (rows.select("text").mapInArrow(run, "lead long")
            .agg(F.percentile_approx("lead", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts")).first()["cuts"])
    return np.unique(np.array(cuts or [], np.int64))


def places(column):
    return np.array([LOWEST if i is None else i for i in column.to_pylist()], np.int64)


def runs(doc, start, m):
    """Join runs of windows that touch."""
    order = np.lexsort((start, doc))
    doc, start, m = doc[order], start[order], m[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + m[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(m, at) if len(at) else m


def suffix_rows(docs, cuts, buckets):
    """Segments by range of their suffix (kind 0), less those that repeat an earlier one of the same task (runs, kind 1)."""
    def run(batches):
        key, first_doc, first_start = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = places(batch.column("doc_id"))
            order = np.argsort(own, kind="stable")
            own, parts = own[order], []
            for row0, data, offsets in chunks(batch.column("text").take(pa.array(order)), CHUNK // 2):
                row, first, m, anchor, gram, kind, more = segments(data, offsets)
                parts.append((gram, kind, more, own[row + row0], first - offsets[row], m, leads(data, anchor)))
            gram, kind, more, doc, start, m, lead = (np.concatenate(x) for x in zip(*parts))
            # earliest of each class in this batch, then against the earliest of the batches before
            both = mix(mix(gram * ROOT + kind) * ROOT + more)
            _, at, of = np.unique(both, return_index=True, return_inverse=True)
            mine = both[at]
            found = np.searchsorted(key, mine)
            known = np.zeros(len(mine), bool)
            if len(key):
                known = key[np.minimum(found, len(key) - 1)] == mine
            old_doc, old_start = doc[at].copy(), start[at].copy()
            old_doc[known], old_start[known] = first_doc[found[known]], first_start[found[known]]
            later = (old_doc[of] < doc) | ((old_doc[of] == doc) & (old_start[of] < start))
            first_here = (doc[at] < old_doc) | ((doc[at] == old_doc) & (start[at] <= old_start))
            best_doc, best_start = np.where(first_here, doc[at], old_doc), np.where(first_here, start[at], old_start)
            later |= (best_doc[of] < doc) | ((best_doc[of] == doc) & (best_start[of] < start))
            first_doc[found[known]], first_start[found[known]] = best_doc[known], best_start[known]
            key = np.concatenate([key, mine[~known]])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first_doc = np.concatenate([first_doc, best_doc[~known]])[order]
            first_start = np.concatenate([first_start, best_start[~known]])[order]
            keep = ~later
            bucket = np.searchsorted(cuts, lead[keep])
            yield batch_of(bucket, gram[keep], kind[keep], doc[keep], start[keep], m[keep], 0, more[keep])
            doc, start, m = runs(doc[later], start[later], m[later])
            none = np.zeros(len(doc), np.uint64)
            yield batch_of(np.arange(len(doc)) % buckets, none, none, doc, start, m, 1)

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def batch_of(bucket, gram, kind, doc, start, m, what, more=None):
    more = np.zeros(len(doc), np.uint64) if more is None else more
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(kind.view(np.int64)),
         pa.array(more.view(np.int64)), pa.array(doc), pa.array(start), pa.array(m.astype(np.int32)), pa.array(np.full(len(doc), what, np.int32))],
        ["bucket", "gram", "class", "more", "doc", "start", "m", "kind"])


class Meeting:
    """A sorted stream of segments, batch by batch, with what went before."""

    def __init__(self):
        self.gram = self.kind = self.more = self.held = None
        self.doc = self.start = 0

    def step(self, gram, kind, doc, start, m, more=None):
        """(mask of repeats; first segments, as gram, doc, start, m, of classes whose gram has several)."""
        more = np.zeros_like(kind) if more is None else more
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1]) | (more[1:] != more[:-1])
        same_gram = self.gram is not None and gram[0] == self.gram
        new[0] = not (same_gram and kind[0] == self.kind and more[0] == self.more)
        head = np.maximum.accumulate(np.where(new, np.arange(len(gram)), -1))
        head_doc, head_start = np.where(head < 0, self.doc, doc[head]), np.where(head < 0, self.start, start[head])
        repeat = ~new & ((doc != head_doc) | (start != head_start))
        at, first = np.flatnonzero(new), None
        emit = np.zeros(len(at), bool)
        if not same_gram:
            self.held = None
        if len(at):
            label = np.cumsum(np.append(True, gram[at][1:] != gram[at][:-1])) - 1
            emit = np.bincount(label)[label] > 1
            if same_gram and gram[at[0]] == self.gram:
                emit |= label == 0
                first, self.held = self.held, None
            if not emit[-1]:
                self.held = [x[at[-1]:at[-1] + 1] for x in (gram, doc, start, m)]
            elif label[-1] > 0 or not same_gram:
                self.held = None
        out = [x[at[emit]] for x in (gram, doc, start, m)]
        if first is not None:
            out = [np.concatenate(x) for x in zip(first, out)]
        self.gram, self.kind, self.more, self.doc, self.start = gram[-1], kind[-1], more[-1], head_doc[-1], head_start[-1]
        return repeat, out


def met(rows):
    """kind 1: runs of windows that repeat earlier ones; kind 2: first segments of classes that share a gram with others."""
    def out(what, gram, doc, start, m):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), what, np.int32)), pa.array(gram), pa.array(doc),
                                           pa.array(start), pa.array(np.asarray(m, np.int32))], ["kind", "gram", "doc", "start", "m"])

    def run(batches):
        state = Meeting()
        for batch in batches:
            gram, kind, more, doc, start, m, what = (batch.column(c).to_numpy(zero_copy_only=False)
                                                     for c in ("gram", "class", "more", "doc", "start", "m", "kind"))
            done = what == 1
            if done.any():
                yield out(1, gram[done], doc[done], start[done], m[done])
            if not done.all():
                gram, kind, more, doc, start, m = (x[~done] for x in (gram, kind, more, doc, start, m))
                repeat, heads = state.step(gram, kind, doc, start, m, more)
                doc, start, m = runs(doc[repeat], start[repeat], m[repeat])
                yield out(1, np.zeros(len(doc), np.int64), doc, start, m)
                yield out(2, *heads)

    return (rows.repartition("bucket").sortWithinPartitions("kind", "gram", "class", "more", "doc", "start")
            .mapInArrow(run, "kind int, gram long, doc long, start long, m int"))


def pressed(docs):
    """doc_id, doc, blob: documents with compressed bytes, for a cheap shuffle."""
    def run(batches):
        import zstandard
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = [press.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(places(batch.column("doc_id"))),
                                              pa.array(blobs, pa.binary())], ["doc_id", "doc", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc long, blob binary")


def opened(blob, press):
    return np.frombuffer(press.decompress(blob, max_output_size=1 << 31), np.uint8) if blob else np.zeros(0, np.uint8)


def cut(texts, heads, buckets):
    """Segments with their bytes; those of hot grams as single windows (hot = true), the first of each task."""
    wanted = heads.groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "m", "hot")).alias("cuts"))

    def run(batches):
        import zstandard
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, blob, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc", "blob", "cuts"))):
                data = opened(blob, press)
                gram, start, m, bytes_ = [], [], [], []
                windows = []
                for c in cuts:
                    if c["hot"]:
                        windows += range(c["start"], c["start"] + c["m"])
                        continue
                    gram.append(c["gram"])
                    start.append(c["start"])
                    m.append(c["m"])
                    bytes_.append(data[c["start"]:c["start"] + c["m"] + LENGTH - 1].tobytes())
                low = [0] * len(gram)
                if windows:
                    at = np.array(windows, np.int64)
                    small, large = window_hashes(data)
                    one = mix(mix(large[at] * ROOT + large[at + LENGTH - 64]) + np.uint64(1))
                    two = mix(mix(large[at + LENGTH - 64] * ROOT + large[at]) + np.uint64(2))
                    gram += one.view(np.int64).tolist()
                    low += two.view(np.int64).tolist()
                    start += windows
                    m += [1] * len(windows)
                    bytes_ += [None] * len(windows)
                hot = [b is None for b in bytes_]
                # a gram has one range, as do equal windows
                bucket = [g % buckets for g in gram]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), pa.array(hot), pa.array(gram, pa.int64()), pa.array(low, pa.int64()),
                     pa.array([doc] * len(gram), pa.int64()), pa.array(start, pa.int64()), pa.array(m, pa.int32()),
                     pa.array(bytes_, pa.binary())], ["bucket", "hot", "gram", "class", "doc", "start", "m", "bytes"])

    return (texts.select("doc", "blob").join(wanted, "doc")
            .mapInArrow(run, "bucket int, hot boolean, gram long, class long, doc long, start long, m int, bytes binary"))


def repeats(group, doc, start, m, data, at):
    """Runs (doc, start, m) of windows that an earlier window of the same group equals.

    Multikey quicksort with eight bytes a key: the windows of each tie are
    parted by their next eight bytes until all LENGTH are used up.
    """
    owner = np.repeat(np.arange(len(m)), m)
    step = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(m)[:-1]])[owner]
    place = at[owner] + step
    word = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | data[i:len(word) + i]
    live, tie = np.arange(len(owner)), group[owner]
    for depth in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        key = word[place[live] + depth]
        order = np.lexsort((key, tie))
        live, key, tie = live[order], key[order], tie[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
        tie = np.cumsum(new)
        more = np.bincount(tie)[tie] > 1
        live, tie = live[more], tie[more]
    order = np.lexsort((start[owner[live]] + step[live], doc[owner[live]], tie))
    live, tie = live[order], tie[order]
    own_doc, own_start = doc[owner[live]], start[owner[live]] + step[live]
    first = np.ones(len(live), bool)
    first[1:] = tie[1:] != tie[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))
    late = (own_doc != own_doc[head]) | (own_start != own_start[head])
    return runs(own_doc[late], own_start[late], np.ones(late.sum(), np.int64))


def sorted_out(cuts):
    """doc, start, m: the runs of windows of cut segments that repeat earlier ones."""
    def out(doc, start, m):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(np.asarray(m, np.int32))], ["doc", "start", "m"])

    def settle(rows):
        gram, doc, start, m, bytes_ = zip(*rows)
        data = np.frombuffer(b"".join(bytes_), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(b) for b in bytes_])])[:-1]
        _, group = np.unique(np.array(gram, np.int64), return_inverse=True)
        return out(*repeats(group, np.array(doc, np.int64), np.array(start, np.int64), np.array(m, np.int64), data, at))

    def run(batches):
        state, held, size = Meeting(), [], 0
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            if hot.any():
                part = batch.filter(pa.array(hot))
                gram, kind, doc, start, m = (part.column(c).to_numpy(zero_copy_only=False)
                                             for c in ("gram", "class", "doc", "start", "m"))
                late, _ = state.step(gram, kind, doc, start, m)
                yield out(*runs(doc[late], start[late], m[late]))
            part = batch.filter(pa.array(~hot))
            for row in zip(*(part.column(c).to_pylist() for c in ("gram", "doc", "start", "m", "bytes"))):
                if size > TOGETHER and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield settle(held)

    return (cuts.repartition("bucket").sortWithinPartitions("hot", "gram", "class", "doc", "start")
            .mapInArrow(run, "doc long, start long, m int"))


def repeated_windows(docs, texts):
    """doc, start, m: runs of windows of documents that equal earlier windows."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(met(suffix_rows(docs, splitters(docs, buckets), buckets)), "segments")
    heads = found.where("kind = 2").drop("kind")
    hot = heads.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    heads = heads.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    late = sorted_out(cut(texts, heads, buckets))
    return found.where("kind = 1").select("doc", "start", "m").union(late)


def removed(docs):
    """doc_id, n_bytes, n_removed, spans (start, end), kept (bytes) of every row of documents (integer doc_id, text).

    A byte goes if a LENGTH-byte string over it also starts earlier: in a
    document with a smaller doc_id, or further ahead in the same one.

    Defined results: texts are UTF-8 bytes, null is empty; texts under LENGTH
    bytes lose nothing, and matches never cross documents. Rows of one doc_id
    are copies of one document, which do not repeat each other. A null doc_id
    comes before all others. Other columns are passed over.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = pressed(docs)
    late = repeated_windows(docs, texts).groupBy("doc").agg(F.collect_list(F.struct("start", "m")).alias("runs"))

    def run(batches):
        import zstandard
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for blob, found in zip(batch.column("blob").to_pylist(), batch.column("runs").to_pylist()):
                data, spans = opened(blob, press), []
                for start, end in sorted((r["start"], r["start"] + r["m"] + LENGTH - 1) for r in found or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                keep = np.ones(len(data), bool)
                for start, end in spans:
                    keep[start:end] = False
                out.append((len(data), int(len(data) - keep.sum()), [{"start": a, "end": b} for a, b in spans], data[keep].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                 pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([x[3] for x in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return texts.join(late, "doc", "left").select("doc_id", "blob", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def suffix_dedup(docs):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents; see `removed`."""
    return removed(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                F.sha2("kept", 256).alias("kept_sha256"))
