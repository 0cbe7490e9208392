"""Exact deduplication by an index of cuckoo filters over live digests, with their contents beside them.

A digest is the SHA-256 of a text whose runs of white space are one space. The
index is cut into shards by digest; a shard is one cuckoo filter with its keys.
Texts are inserted shard by shard: equal texts meet in the task that reads them,
one row for each goes to its shard, and there every digest is looked up. A miss
is inserted and its content stored; a hit is verified against the stored
content. Filters that overflow grow from their keys. Deleted documents take
their digest out of the filter when nobody has it any more.

An index is a set of Parquet folders in shared storage that are never changed;
operations write new ones, so a lost executor costs a task and a failed job
nothing. `filters` has a row a shard, `contents` a row for each text, `entries`
its keep_id and size, `members` digest and doc_id of each document.
"""

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.cuckoo import CuckooFilter
from twinframe.llm.text import chunks
from twinframe.shared import new_path, spread

#: Plan settings only: bytes of text in which a task looks for equal texts, keys a shard, least number of shards.
WINDOW = 32 << 20
KEYS, SHARDS = 1 << 16, 1 << 10
#: A digest with more members than this, and than one in HEAVY of all, is joined by broadcast; there are HEAVY at most.
HOT, HEAVY = 10_000, 10_000

FILTERS = "shard int, n_buckets int, prints binary, keys binary"
ENTRIES = "digest binary, keep_id bigint, n bigint"
CONTENTS = "digest binary, content binary"
MEMBERS = "digest binary, doc_id bigint"
WORK = "kind string, shard int, digest binary, content binary, keep_id bigint, n bigint, n_buckets int, prints binary, keys binary"


@dataclass(frozen=True)
class ExactIndex:
    """The folders of one state of an index."""

    spark: object
    shards: int
    filters: tuple = ()
    contents: tuple = ()
    entries: tuple = ()
    members: tuple = ()

    def _read(self, folders, schema):
        reader = self.spark.read.schema(schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def live(self):
        """digest, keep_id, n of every text that has documents."""
        rows = self._read(self.entries, ENTRIES)
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def table(self, name):
        return self._read(getattr(self, name), {"filters": FILTERS, "contents": CONTENTS, "members": MEMBERS}[name])


def empty_index(spark, expected):
    """An index without documents, cut for so many. With more, its filters grow beyond KEYS keys each."""
    shards = SHARDS
    while shards * KEYS < expected:
        shards *= 2
    return ExactIndex(spark, shards)


def digested(docs):
    """doc_id, content (UTF-8 of the text with one space for each run of white space), digest of every row."""
    content = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t-\\r]+", " ").cast("binary")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("content"))
            .withColumn("digest", F.unhex(F.sha2("content", 256))))


def shard_of(digest, shards):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _verified(stored, content):
    if stored != content:
        raise ValueError("two texts of one SHA-256")


def combined(rows):
    """digest, content, keep_id, n: equal texts that a task reads close to each other are one row."""
    def combine(batches):
        held, size = {}, 0
        def flush():
            texts = [(d, *v) for d, v in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts), SCHEMA.types)], SCHEMA.names)
        for batch in batches:
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            for first, data, offsets in chunks(batch.column("content")):
                for i, (a, z) in enumerate(zip(offsets, offsets[1:]), first):
                    content, known = data[a:z].tobytes(), held.get(digests[i])
                    if known is None:
                        held[digests[i]] = [content, ids[i], 1]
                        size += len(content) + 200
                    else:
                        _verified(known[0], content)
                        known[1], known[2] = _least(known[1], ids[i]), known[2] + 1
                if size >= WINDOW:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    SCHEMA = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
    return rows.select("doc_id", "digest", "content").mapInArrow(combine, f"{CONTENTS}, keep_id bigint, n bigint")


def _rows(schema_text, **columns):
    """A record batch of WORK rows; columns that are not given are null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}
    fields = [f.split() for f in schema_text.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in fields], [c for c, _ in fields])


def _in_shards(work, names):
    """Run a batch of rows through the filters of their shards.

    Rows come sorted by shard, kind and digest: `0` is the stored filter, `delete`
    and `insert` are digests. Out come `filter` rows, for each inserted digest an
    `entry`, and with it its `content` if it is new or `check` if it was live.
    Only one filter and one batch of rows are held at a time.
    """
    def run(batches):
        shard, filter_, out = None, None, {n: [] for n in names}
        current, live, content, keep, n = None, False, None, None, 0

        def ended_digest():
            if current is not None:
                out["entry"].append((shard, current, None, keep, n))

        def ended_shard():
            if shard is not None:
                stored.append((shard, *filter_.stored()))

        def flush():
            for kind, rows in out.items():
                if rows:
                    s, d, c, k, m = zip(*rows)
                    yield _rows(WORK, kind=[kind] * len(rows), shard=s, digest=d, content=c, keep_id=k, n=m)
                    rows.clear()
            if stored:
                s, b, p, k = zip(*stored)
                yield _rows(WORK, kind=["filter"] * len(stored), shard=s, n_buckets=b, prints=p, keys=k)
                stored.clear()

        stored = []
        for batch in batches:
            shards, kinds, digests, keeps, ns = (batch.column(c).to_pylist() for c in ("shard", "kind", "digest", "keep_id", "n"))
            for first, data, offsets in chunks(batch.column("content")):
                for i, (a, z) in enumerate(zip(offsets, offsets[1:]), first):
                    if shards[i] != shard:
                        ended_digest()
                        ended_shard()
                        shard, filter_, current = shards[i], CuckooFilter(), None
                    if kinds[i] == "0":
                        filter_ = CuckooFilter(*(batch.column(c)[i].as_py() for c in ("n_buckets", "prints", "keys")))
                    elif kinds[i] == "delete":
                        filter_.delete(digests[i])
                    elif digests[i] == current:
                        _verified(content, data[a:z].tobytes())
                        keep, n = _least(keep, keeps[i]), n + ns[i]
                    else:
                        ended_digest()
                        current, content, keep, n = digests[i], data[a:z].tobytes(), keeps[i], ns[i]
                        live = filter_.find(current) >= 0
                        if not live:
                            filter_.insert(current)
                        out["check" if live else "content"].append((shard, current, content, None, None))
                yield from flush()
        ended_digest()
        ended_shard()
        yield from flush()

    sorted_rows = work.repartition("shard").sortWithinPartitions("shard", "kind", "digest")
    return sorted_rows.mapInArrow(run, WORK)


def _changed(index, rows):
    """(folder of what `_in_shards` made, by kind) of the index's filters and rows of (kind, digest, content, keep_id, n)."""
    null = lambda kind: F.lit(None).cast(kind)
    new = rows.select("kind", shard_of("digest", index.shards).alias("shard"), "digest", "content", "keep_id", "n",
                      null("int").alias("n_buckets"), null("binary").alias("prints"), null("binary").alias("keys"))
    old = index.table("filters").select(
        F.lit("0").alias("kind"), "shard", null("binary").alias("digest"), null("binary").alias("content"),
        null("bigint").alias("keep_id"), null("bigint").alias("n"), "n_buckets", "prints", "keys")
    work = old.unionByName(new) if index.filters else new
    path = new_path(index.spark, "exact-index")
    _in_shards(work, ("entry", "content", "check")).write.partitionBy("kind").parquet(path)
    made = {r.kind for r in index.spark.read.schema("kind string, shard int").parquet(path).select("kind").distinct().collect()}
    return {kind: (f"{path}/kind={kind}",) for kind in made}  # at most four kinds


def insert(index, docs):
    """The index with documents (doc_id, text) added.

    Of a text that was live before, content and stored content are compared; two
    texts of one digest end the job.
    """
    rows = digested(spread(docs))
    path = new_path(index.spark, "members")
    rows.select("digest", "doc_id").write.parquet(path)
    made = _changed(index, combined(rows).select(F.lit("insert").alias("kind"), "digest", "content", "keep_id", "n"))
    if "check" in made:
        asked = index.spark.read.schema(CONTENTS).parquet(*made["check"])
        stored = index.table("contents").withColumnRenamed("content", "stored")
        if not asked.join(stored, "digest", "left").where(~F.col("content").eqNullSafe(F.col("stored"))).isEmpty():
            raise ValueError("two texts of one SHA-256")
    return replace(index, filters=made.get("filter", index.filters), contents=index.contents + made.get("content", ()),
                   entries=index.entries + made.get("entry", ()), members=index.members + (path,))


def delete(index, ids):
    """The index without the documents of `ids` (doc_id); ids that it has not are passed over, null matches null."""
    gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    members = index.table("members")
    same = members["doc_id"].eqNullSafe(gone["doc_id"])
    touched = members.join(gone, same, "left_semi").select("digest").distinct()
    path, entries, contents = (new_path(index.spark, x) for x in ("members", "entries", "contents"))
    members.join(gone, same, "left_anti").write.parquet(path)
    left = (index.spark.read.schema(MEMBERS).parquet(path).groupBy("digest")
            .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")))
    left.write.parquet(entries)
    after = replace(index, members=(path,), entries=(entries,))
    dead = touched.join(after.live().select("digest"), "digest", "left_anti")
    index.table("contents").join(dead, "digest", "left_anti").write.parquet(contents)
    null = lambda kind: F.lit(None).cast(kind)
    made = _changed(index, dead.select(F.lit("delete").alias("kind"), "digest", null("binary").alias("content"),
                                       null("bigint").alias("keep_id"), null("bigint").alias("n")))
    return replace(after, contents=(contents,), filters=made.get("filter", ()))


def duplicates(index):
    """doc_id, keep_id, group_size, kept, text_sha256 of every document of the index.

    Digests that very many documents have are broadcast, the others meet their entry by a join.
    """
    members, live = index.table("members"), index.live()
    total = live.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT, total // HEAVY)
    heavy = F.broadcast(live.where(hot))  # HEAVY rows at most, by the sum of n
    rows = members.join(heavy, "digest").unionByName(
        members.join(heavy.select("digest"), "digest", "left_anti").join(live.where(~hot), "digest"))
    return rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs):
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, through a new index of all of them.

    Texts are equal if they are identical after every run of `[\\x20\\x09-\\x0D]` is
    one space. Of equal texts the row with the smallest doc_id stays.

    Defined results: null is an empty text, and empty texts are equal. Rows that
    repeat doc_id and text have one decision, since nothing tells them apart. A
    null doc_id never stands for others: it is kept only where all of its texts
    have none, and keep_id is then null. No documents give no rows. Other columns
    are passed over. Texts are held one at a time.
    """
    index = empty_index(docs.sparkSession, docs.count())
    return duplicates(insert(index, docs))
