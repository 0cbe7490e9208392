"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact sets.

Documents are sets of word shingles. Equal sets are one node. Nodes that share
a band of their MinHash signature are candidates. At first every bucket compares
its members with its smallest one, and small buckets all their pairs. In large
buckets that then still hold several components, what is outside the largest
one is compared, in blocks of signatures, with that component and with one
another, so every candidate pair is decided and none is written out. Signatures
are compared batch by batch; after each batch a pair is dropped when the
posterior of a similarity at or above the threshold is below the chosen miss
probability. Survivors are confirmed on their full sets.
"""

import hashlib
import math
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.buckets import buckets, candidates
from twinframe.llm.components import components
from twinframe.llm.text import chunks, mix, raw, shingles
from twinframe.shared import written

BAND_ROWS, BANDS, BATCH = 4, 32, 16
SIZE = BAND_ROWS * BANDS
_seeds = np.random.default_rng(20)
SCALE = _seeds.integers(0, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1)
SHIFT = _seeds.integers(0, 1 << 32, SIZE, dtype=np.uint32)
SPREAD = np.uint32(0x85EBCA6B)  # fixed odd multiplier
#: Plan settings only: texts of one pivot's partners, and signatures of one block, that one task compares; links that one task joins.
TOGETHER, BLOCK, FEW_LINKS = 256, 1024, 200_000


def signatures(hashes, at):
    """MinHash signatures (rows x SIZE) of runs of shingle hashes; every run has at least one."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SIZE, len(at) - 1), np.uint32)
    for i in range(SIZE):
        h = x * SCALE[i] + SHIFT[i]
        h ^= h >> np.uint32(15)
        h *= SPREAD
        np.minimum.reduceat(h, at[:-1], out=out[i])
    return np.ascontiguousarray(out.T)


def sketch(docs, width):
    """doc_id, n_shingles, digest of the set, signature, two bits of each place; the last three are null for empty sets."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in chunks(batch.column("text"), 1 << 18):
                hashes, at = shingles(data, offsets, width)
                rows = len(at) - 1
                full = np.flatnonzero(np.diff(at))
                sizes, digests, signs, briefs = np.zeros(rows, np.int64), [None] * rows, [None] * rows, [None] * rows
                if len(full):
                    signed = signatures(hashes, np.append(at[full], at[-1]))
                    brief = ((signed & 3).astype(np.uint8).reshape(len(full), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)
                    for k, row in enumerate(full):
                        found = np.unique(hashes[at[row]:at[row + 1]])
                        sizes[row] = len(found)
                        digests[row] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                        signs[row], briefs[row] = signed[k].tobytes(), brief[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, rows), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()),
                     pa.array(briefs, pa.binary())], ["doc_id", "n_shingles", "digest", "sign", "brief"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sign binary, brief binary")


def band_values(signs):
    """One 64-bit value for each signature and band."""
    words = np.frombuffer(b"".join(signs), np.uint32).reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), words.shape[:2])
    for i in range(BAND_ROWS):
        out = mix(out ^ (words[:, :, i] + (out << np.uint64(7))))
    return out


def band_keys(nodes):
    """key, band, id: one row for each node and band."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = band_values(part.column("sign").to_pylist())
                bands = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(bands), pa.array(ids)],
                                                 ["key", "band", "id"])

    return nodes.select("id", "sign").mapInArrow(run, "key long, band int, id long")


def least_matches(threshold, miss, batch=BATCH):
    """After each batch: the fewest equal places at which the posterior of `threshold` or more is at least `miss`.

    With a uniform prior, the posterior after m of n equal places is
    P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(batch, SIZE + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def likely(pairs, nodes, percent, miss, folders):
    """The pairs (a, b) that sequential Bayesian comparison keeps, with their equal places.

    Sizes and two bits of each place come first, the whole places only for the
    pairs that are left. Two bits agree by chance in a quarter of other places.
    """
    chance = percent / 100 + (1 - percent / 100) / 4
    brief = least_matches(chance, miss, SIZE)[-1]
    least = least_matches(percent / 100, miss)

    def sides(batch, kind, width, *columns):
        return [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(-1, width) for c in columns]

    def short(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                a, b = sides(part, np.uint8, SIZE // 4, "brief_a", "brief_b")
                off = a ^ b
                off = (off | off >> 1) & 0x55
                keep = pa.array(np.flatnonzero(SIZE - np.bitwise_count(off).sum(1, dtype=np.int64) >= brief))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], ["a", "b"])

    def whole(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                a, b = sides(part, np.uint32, SIZE, "sign_a", "sign_b")
                alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
                for k, need in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    equal[alive] += (a[alive, at] == b[alive, at]).sum(1)
                    alive = alive[equal[alive] >= need]
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep),
                                                  pa.array(equal[alive])], ["a", "b", "equal"])

    def with_sides(pairs, *columns):
        for c in "ab":
            pairs = pairs.join(nodes.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
        return pairs

    alike = (F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b"))
    few = with_sides(pairs, "n", "brief").where(alike).select("a", "b", "brief_a", "brief_b").mapInArrow(short, "a long, b long")
    # written, so that its size is known: signatures are shuffled only if it is too large for a broadcast
    return with_sides(written(few, "few", folders), "sign").mapInArrow(whole, "a long, b long, equal long")


def in_blocks(queries, members, percent, miss, width, with_texts):
    """Links (a, b) between queries and members of one group that join their roots into the same sets as all links would.

    Both sides are group, id, root. Members are dealt into blocks, and the
    queries, in blocks as well, go to each of them. Tasks compare signatures in
    place and confirm what is left on full sets; a pair of roots that the task
    has joined needs no further link.
    """
    least = least_matches(percent / 100, miss)

    def parts(side, name):
        return side.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias(name))

    many = parts(queries, "of_queries").join(parts(members, "of_members"), "group")
    rows = None
    for name, side, other_name in (("queries", queries, "of_members"), ("members", members, "of_queries")):
        own = F.pmod(F.xxhash64("id"), f"of_{name}")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_name) - 1))
        dealt = side.join(many, "group").select("group", "id", "root", own.alias("own"), other.alias("other"))
        first, second = ("own", "other") if name == "queries" else ("other", "own")
        dealt = dealt.select("group", F.col(first).alias("x"), F.col(second).alias("y"), F.lit(name == "members").alias("member"), "id", "root")
        rows = dealt if rows is None else rows.union(dealt)

    def run(batches):
        now, held, up, sets = None, [], {}, {}

        def root(r):
            while up.get(r, r) != r:
                r = up[r]
            return r

        def set_of(i, text):
            if i not in sets:
                sets[i] = np.unique(shingles(*raw(pa.array([text])), width)[0])
            return sets[i]

        def compare(queries, members):
            ids, roots, sizes, signs, texts = members
            for q_id, q_root, q_size, q_sign, q_text in zip(*queries):
                alive = np.flatnonzero((roots != q_root) & (np.minimum(sizes, q_size) * 100 >= percent * np.maximum(sizes, q_size)))
                equal = np.zeros(len(ids), np.int64)
                for k, need in enumerate(least):
                    if not len(alive):
                        break
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    equal[alive] += (signs[alive, at] == q_sign[at]).sum(1)
                    alive = alive[equal[alive] >= need]
                for i in alive[np.argsort(-equal[alive], kind="stable")]:
                    x, y = root(int(q_root)), root(int(roots[i]))
                    if x == y:
                        continue
                    one, two = set_of(int(q_id), q_text), set_of(int(ids[i]), texts[i])
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        up[max(x, y)] = min(x, y)
                        yield min(int(q_id), int(ids[i])), max(int(q_id), int(ids[i]))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "x", "y"))))
            member = batch.column("member").to_numpy(zero_copy_only=False)
            ids, roots, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "n"))
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, SIZE)
            texts = batch.column("text").to_pylist()
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or member[i] != member[i - 1]] + [len(keys)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if keys[a] != now:
                    now, held, up, sets = keys[a], [], {}, {}
                part = ids[a:b], roots[a:b], sizes[a:b], signs[a:b], texts[a:b]
                if not member[a]:
                    held.append(part)
                    continue
                for query in held:
                    out += compare(query, part)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())],
                                             ["a", "b"])

    return (with_texts(rows).repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "member")
            .select("group", "x", "y", "member", "id", "root", "n", "sign", "text").mapInArrow(run, "a long, b long"))


def undecided(nodes, members, roots, small, percent, miss, width, docs, texts, folders):
    """Links between the components that buckets of more than `small` members still hold."""
    rooted = nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("root"))
    rows = (members.where(F.col("n") > small).select("key", "id").join(roots, "id", "left")
            .select("key", "id", F.coalesce("component", "id").alias("root")))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("m"))
    open_ = (sizes.groupBy("key").agg(F.max_by("root", "m").alias("main"), F.sum("m").alias("n"), F.max("m").alias("top"))
             .where((F.col("n") > small) & (F.col("n") > F.col("top"))).select(F.col("key").alias("open_key"), "main"))
    outside = written(rows.join(open_, (F.col("key") == F.col("open_key")) & (F.col("root") != F.col("main")))
                      .select("key", "main", "id", "root"), "outside", folders)
    # what is outside against the whole largest component, and against what else is outside in its bucket
    name = lambda kind, c: F.xxhash64(F.lit(kind), c)
    queries = outside.select(name("main", "main").alias("group"), "id", "root").distinct()
    mains = outside.select("main").distinct()
    others = outside.select(name("key", "key").alias("group"), "id", "root")
    members = (rooted.select("id", "root").join(mains, F.col("root") == F.col("main"), "left_semi")
               .select(name("main", "root").alias("group"), "id", "root"))
    queries = written(queries.union(others), "queries", folders)
    members = written(members.union(others), "members", folders)

    def with_texts(rows):
        known = _fetch(docs, queries.select("id").union(members.select("id")), texts, folders)
        return rows.join(nodes.select("id", "n", "sign"), "id").join(known, "id")

    return in_blocks(queries, members, percent, miss, width, with_texts)


def confirm(pairs, texts, percent, width):
    """The pairs whose full sets are similar enough: 100 * both >= percent * either.

    The texts of a pivot's partners stream past its set. Partners of a pivot
    with very many of them are dealt over several tasks.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    member = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("id"))
    pivot = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                         F.col("a").alias("id"))
    need = member.union(pivot).join(texts, "id")

    def run(batches):
        now, base = None, None
        for batch in batches:
            a, part, ids = (batch.column(c).to_pylist() for c in ("a", "part", "id"))
            out = []
            for first, data, offsets in chunks(batch.column("text"), 1 << 19):
                hashes, at = shingles(data, offsets, width)
                for i in range(len(at) - 1):
                    row = first + i
                    own = np.unique(hashes[at[i]:at[i + 1]])
                    if ids[row] == a[row]:
                        now, base = (a[row], part[row]), own
                    elif now == (a[row], part[row]):
                        both = len(np.intersect1d(base, own, assume_unique=True))
                        if 100 * both >= percent * (len(base) + len(own) - both):
                            out.append((a[row], ids[row]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    # a pivot is the smaller id of its pairs, so it comes first
    return need.repartition("a", "part").sortWithinPartitions("a", "part", "id").mapInArrow(run, "a long, b long")


def near_duplicates(docs, percent=75, width=5, miss=1e-6, small=8):
    """doc_id, n_shingles, component_id, kept for every row of documents (integer doc_id, text).

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of `width`-word shingles; a component is named by its smallest
    doc_id, which is the one kept.

    Defined results: a text with fewer words is one shingle; null texts and
    texts without words have an empty set, are linked with nothing and kept.
    Rows of one doc_id count as one document. Rows without a doc_id are linked
    with nothing, have no component and are kept. `small`, TOGETHER and BLOCK
    only steer the plan. Other columns are passed over. Scratch tables go when
    their last reader is done; two narrow ones stay for the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with ExitStack() as folders:
        with ExitStack() as first:
            sketches = written(sketch(docs, width), "sketches", first)
            usable = sketches.where("doc_id is not null and digest is not null")
            nodes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("sign").alias("sign"),
                                                         F.any_value("brief").alias("brief"), F.max("n_shingles").alias("n")),
                            "nodes", folders)
            base = written(sketches.select("doc_id", "n_shingles", "digest"), "base")
        members = written(buckets(band_keys(nodes), None, folders), "buckets", folders)
        found = written(likely(candidates(members, small), nodes, percent, miss, folders), "likely", folders)
        texts = _fetch(docs, found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))), None, folders)
        # first the likeliest partner of each document, then what the components so found leave open
        best = (found.groupBy("b").agg(F.max(F.struct("equal", (-F.col("a")).alias("a"))).alias("x"))
                .select((-F.col("x.a")).alias("a"), "b"))
        links, roots = _add(None, confirm(best, texts, percent, width), folders)
        rest = found.join(best, ["a", "b"], "left_anti")
        for c in "ab":
            rest = (rest.join(roots.select(F.col("id").alias(c), F.col("component").alias(f"root_{c}")), c, "left")
                    .withColumn(f"root_{c}", F.coalesce(f"root_{c}", c)))
        rest = written(rest.where("root_a <> root_b").select("a", "b"), "rest", folders)
        links, roots = _add(links, confirm(rest, texts, percent, width), folders)
        links, roots = _add(links, undecided(nodes, members, roots, small, percent, miss, width, docs, texts, folders), folders)
        # the result reads two narrow tables only: base and this one
        named = written(nodes.select("digest", "id").join(roots, "id", "left")
                        .select("digest", F.coalesce("component", "id").alias("component")), "named")
    return (base.join(named, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _fetch(docs, ids, texts, folders):
    """(id, text) of the documents named, besides those fetched before."""
    ids = ids.distinct()
    if texts is not None:
        ids = ids.join(texts.select("id"), "id", "left_anti")
    # written, so that its size is known: documents are shuffled only if it is too large for a broadcast
    ids = written(ids, "ids", folders)
    if texts is not None and ids.isEmpty():
        return texts
    more = written(docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"), "texts", folders)
    return more if texts is None else texts.union(more)


def _add(links, more, folders):
    more = written(more.distinct(), "confirmed", folders)
    links = more if links is None else links.union(more)
    return links, written(components(links, few=FEW_LINKS), "roots", folders)
