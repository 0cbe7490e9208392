"""Document fingerprints of improbable features.

All windows of a text's bytes are ranked by how rare their entropy is among the
windows of all documents; windows rarer than their neighbours become features.
Long texts have windows of 64 bytes, short ones of 8, and texts in between have
both, so that a text and an edited one always share a kind. Features go into a
chain of Bloom filters of 2,048 bits, and two chains are compared by their bit
overlap, less what chance gives.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.text import chunks, inverse_powers, mix, powers

BITS, PROBES, FULL = 2048, 5, 160
#: Kinds of windows: bytes, neighbours on either side, least and most code points of the texts that have them.
KINDS = ((64, 16, 171, 1 << 62), (8, 2, 0, 384))
#: Entropies are told apart in hundredths of a bit, for each kind apart.
STEPS = 601
LEVELS = STEPS * len(KINDS)
#: Classes of bytes for the entropy: letters without case, digits, and kinds of others.
CLASS = np.full(256, 28, np.uint8)
for _i in range(26):
    CLASS[65 + _i] = CLASS[97 + _i] = _i
CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:192], CLASS[192:] = 26, 27, 29, 30, 31
#: Whole number for each count of a byte in a window; their sum over a window gives its entropy exactly.
_counts = np.arange(max(k[0] for k in KINDS) + 1)
INFORMATION = np.rint(_counts * np.log2(np.maximum(_counts, 1)) * (1 << 20)).astype(np.int64)
GAIN = np.diff(INFORMATION, prepend=0)


def entropy_levels(data, size):
    """Entropy of the byte classes of every window of `size` bytes, from one window to the next by what leaves and enters it."""
    kind = CLASS[data]
    order = np.argsort(kind, kind="stable")
    # where the bytes of each class stand, one class after the other, and the first of the class that lies beyond each one's window
    whole = np.int32 if len(data) < 1 << 25 else np.int64
    place = kind[order].astype(whole) * whole(len(data) + size) + order.astype(whole)
    beyond = np.searchsorted(place, place + whole(size))
    number = np.arange(len(data))
    leaving, entering = np.empty(len(data), np.int32), np.empty(len(data), np.int32)
    leaving[order] = beyond - number
    entering[order] = number + 1 - np.cumsum(np.bincount(beyond, minlength=len(data) + 1)[:len(data)])
    total = np.empty(len(data) - size + 1, np.int64)
    total[0] = INFORMATION[np.bincount(kind[:size], minlength=32)].sum()
    np.cumsum(GAIN[entering[size:]] - GAIN[leaving[:len(data) - size]], out=total[1:])
    total[1:] += total[0]
    # hundredths of a bit, rounded, in whole numbers
    most, bit = int(round(np.log2(size) * (size << 20))), size << 20
    return np.clip((200 * (most - total) + bit) // (2 * bit), 0, STEPS - 1)


def candidates(data, offsets):
    """For each kind (first start, owner of each start, -1 if its window is not within a text; entropy level; hash; neighbours)."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points, length = np.diff(points), np.diff(offsets)
    for i, (size, near, least, most) in enumerate(KINDS):
        rows = np.flatnonzero((points >= least) & (points < most) & (length >= size))
        if not len(rows):
            continue
        owner = np.repeat(rows, length[rows])
        own = data if len(owner) == len(data) else data[np.repeat((points >= least) & (points < most) & (length >= size), length)]
        n = len(own) - size + 1
        owner = np.where(owner[:n] == owner[size - 1:], owner[:n], -1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(len(own)), out=total[1:])
        hashes = mix((total[size:] - total[:n]) * inverse_powers(len(own))[:n])
        yield owner, entropy_levels(own, size) + i * STEPS, hashes, near


def entropy_counts(docs):
    """How many windows of all documents have each entropy level, as an array of LEVELS numbers."""
    def run(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), 1 << 18):
                for owner, level, _, _ in candidates(data, offsets):
                    total += np.bincount(level[owner >= 0], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(total)], ["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def rarity(counts):
    """Rank of each level, the rarest first."""
    out = np.empty(LEVELS, np.uint64)
    out[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return out


def least_of(key, n):
    """The least of every n neighbours, at the first of them."""
    out, width = key, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:len(out) - step], out[step:])
        width += step
    return out


def features(data, offsets, rank):
    """(hash, owner) of the features, by owner. A text shorter than any window is a feature itself, if it is not empty.

    Of equal neighbours the first is rarer. Texts do not touch each other: there
    are more starts without a window between them than neighbours count.
    """
    found, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    none = np.uint64((1 << 64) - 1)
    for owner, level, hashes, near in candidates(data, offsets):
        key = np.where(owner >= 0, (rank[level] << np.uint64(32)) | (hashes >> np.uint64(32)), none)
        around = least_of(np.concatenate([np.full(near, none), key, np.full(near, none)]), near)
        best = np.flatnonzero((owner >= 0) & (key < around[:len(key)]) & (key <= around[near + 1:near + 1 + len(key)]))
        found.append(hashes[best])
        of.append(owner[best])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    found, of = found[order], of[order]
    bare = np.setdiff1d(np.flatnonzero(np.diff(offsets)), of)
    if len(bare):
        own = [int.from_bytes(hashlib.blake2b(data[offsets[i]:offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in bare]
        found, of = np.concatenate([found, np.array(own, np.uint64)]), np.concatenate([of, bare])
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    return found, of


def chain(data, offsets, rank):
    """For each row its chain of filters: an array of bytes, one filter a line."""
    found, of = features(data, offsets, rank)
    rows = len(offsets) - 1
    each = np.bincount(of, minlength=rows)
    first = np.concatenate([[0], np.cumsum(-(-each // FULL))])
    place = np.arange(len(of)) - np.concatenate([[0], np.cumsum(each)])[of]
    bits = np.zeros((first[-1], BITS), bool)
    number = first[of] + place // FULL
    for p in range(PROBES):
        bits[number, (found >> np.uint64(11 * p)).astype(np.int64) & (BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:])]


def text_of(filters):
    return ",".join(base64.b64encode(f.tobytes()).decode() for f in filters)


def likeness(a, b):
    """0 to 1: the mean, over the filters of the shorter chain, of their best overlap above chance."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    set_a, set_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    wide = b.view(np.uint64)
    out = 0.0
    for own, n in zip(a.view(np.uint64), set_a):
        both = np.bitwise_count(wide & own).sum(1, dtype=np.int64)
        chance, most = n * set_b / BITS, np.minimum(n, set_b)
        out += float(np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0)))
    return min(max(out / len(a), 0.0), 1.0)


def edit(text, following):
    """The text with its last third replaced by the beginning of another one."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def packed(docs, splits, edges):
    """bucket, edge, doc_id, tie, blob: each document in its range of ids, compressed, and again in the ranges it leads to."""
    lowest = -(1 << 63)

    def run(batches):
        import zstandard
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id")
            order = np.array([lowest if i is None else i for i in ids.to_pylist()], np.int64)
            bucket = np.searchsorted(splits, order, "left")
            blobs = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            rows, to = list(range(len(order))), list(bucket)
            for i, own in enumerate(order):
                for b in edges.get(int(own), ()):
                    rows.append(i)
                    to.append(b)
            edge = np.arange(len(rows)) >= len(order)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(edge), ids.take(take), pa.array(order[rows]), batch.column("tie").take(take),
                 pa.array([blobs[i] for i in rows], pa.binary())], ["bucket", "edge", "doc_id", "place", "tie", "blob"])

    return (docs.withColumn("tie", F.xxhash64("text"))
            .mapInArrow(run, "bucket int, edge boolean, doc_id long, place long, tie long, blob binary"))


def fingerprints(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of its code points replaced by the first
    as many of the next document in descending order of doc_id (after the last
    the first). near_edited and near_next are the likeness of the fingerprint to
    those of the edited text and of the next document.

    Defined results: a null text is empty; an empty text has the empty
    fingerprint, which is like itself (1) and unlike others (0). Repeated rows
    follow each other; a null doc_id comes last. A single row is its own next.
    Without documents the result is empty. Other columns are passed over.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = rarity(entropy_counts(docs))
    # ranges of ids of about equal size, and the document that follows each range
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10 * parts).alias("cuts")).first()["cuts"]
    splits = np.unique(np.array(cuts or [], np.int64))
    edges = {}

    def tops(batches):
        for batch in batches:
            own = batch.column("place").to_numpy(zero_copy_only=False)
            at = np.searchsorted(splits, own, "left")
            for b in np.unique(at):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own[at == b].max()])], ["bucket", "top"])

    highest = {r["bucket"]: r["top"] for r in docs.select(place.alias("place")).mapInArrow(tops, "bucket int, top long")
               .groupBy("bucket").agg(F.max("top").alias("top")).collect()}  # at most one row a range
    filled = sorted(highest)
    for i, b in enumerate(filled):
        edges.setdefault(highest[filled[i - 1]], []).append(b)

    def run(batches):
        import zstandard
        open_ = zstandard.ZstdDecompressor()

        def pairs():
            held = None
            for batch in batches:
                for b, edge, i, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "edge", "doc_id", "blob"))):
                    text = open_.decompress(blob, max_output_size=1 << 31).decode("utf-8", "surrogatepass") if blob else ""
                    if held is not None and held[0] == b:
                        yield held[1], held[2], text
                    held = None if edge else (b, i, text)

        def output(group):
            # the next document of a row is mostly the row after it
            n, last = len(group), group[-1][2]
            texts = [t for _, t, _ in group] + [edit(t, f) for _, t, f in group] + [last]
            after = [i + 1 if f is group[i + 1][1] else None for i, (_, _, f) in enumerate(group[:-1])] + [2 * n]
            extra = [i for i, k in enumerate(after) if k is None]
            texts += [group[i][2] for i in extra]
            for k, i in enumerate(extra):
                after[i] = 2 * n + 1 + k
            chains = []
            for _, data, offsets in chunks(pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()), 1 << 18):
                chains += chain(data, offsets, rank)
            own, edited, following = chains[:n], chains[n:2 * n], [chains[k] for k in after]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([i for i, _, _ in group], pa.int64()), "n_chars": pa.array([len(t) for _, t, _ in group], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts[n:2 * n]],
                "fingerprint": [text_of(c) for c in own], "edited_fingerprint": [text_of(c) for c in edited],
                "near_edited": pa.array([likeness(a, b) for a, b in zip(own, edited)], pa.float64()),
                "near_next": pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64())})

        group, size = [], 0
        for pair in pairs():
            group.append(pair)
            size += len(pair[1])
            if size > 1 << 19:
                yield output(group)
                group, size = [], 0
        if group:
            yield output(group)

    rows = packed(docs, splits, edges).repartition("bucket").sortWithinPartitions(
        "bucket", "edge", F.desc("place"), F.desc("tie")).select("bucket", "edge", "doc_id", "blob")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
