"""Token ids in range-coded files.

A dataset is a folder of two Parquet tables. `table` holds the shared frequency
table: id, count. `blocks` holds one row a block: shard and block number (files
are shards in ascending doc_id order), `first` (ids before it in its shard),
the documents' ids and lengths, the number of ids, their unsigned crc32, and the
coded ids: lane states, which are the checkpoint where decoding starts, and the
words. Any block decodes alone; a block whose checksum fails raises an error.
"""

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from twinframe.llm import rans
from twinframe.llm.text import LOWER, chunks, inverse_powers, mix, powers, raw
from twinframe.shared import new_path, remove

#: Ids after which a block ends; it holds whole documents. Pieces whose ids a worker remembers.
BLOCK, REMEMBERED = 1 << 18, 1_000_000
END = 1
#: Byte classes: 0 white space, 1 plain letters and their bytes, 2 other ASCII. C3 to C5 begin Latin letters.
CLASS = np.full(256, 2, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 0
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 1
BLOCKS = ("shard int, block int, first long, doc_ids array<long>, lengths array<long>, n_ids long, lanes int, "
          "states binary, words binary, crc32 long")


def pieces(data, offsets):
    """(bytes with plain words in lower case, starts, ends, row offsets) of the parts that the tokenizer treats alone.

    Its pattern parts letters, digits and other characters and drops white
    space, so words are cut between plain letters and other ASCII characters.
    Words with an apostrophe, a special token or a character that is neither
    ASCII nor a plain Latin letter stay whole and as they are.
    """
    n = len(data)
    kind = CLASS[data]
    after = np.append(data[1:], 0)
    odd = (data == 39) | (data == 0xC2) | (data >= 0xC6) | ((data == 60) & (after == 124))
    odd |= ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 0xC4) & (after == 0xB0))
    inside = kind > 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    word = np.cumsum(first) - 1
    whole = np.zeros(int(word[-1]) + 1 if n else 0, bool)
    whole[word[odd & inside]] = True
    stays = whole[np.maximum(word, 0)] if len(whole) else np.zeros(n, bool)
    cut = first.copy()
    cut[1:] |= inside[1:] & (kind[1:] != kind[:-1]) & ~stays[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:]
    start, end = np.flatnonzero(cut), np.flatnonzero(last) + 1
    return np.where(stays, data, LOWER[data]), start, end, np.searchsorted(start, offsets)


class Encoder:
    """Ids of whole texts, by way of the ids of their pieces."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self):
        self.number, self.used = {}, 0
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.mark = np.zeros(1 << 16, np.uint64)

    def learn(self, keys, marks, parts):
        """Remember pieces; `at[i]:at[i + 1]` are the ids of piece i."""
        for k in range(0, len(parts), 4096):
            part = parts[k:k + 4096]
            # one text of ready parts: each is encoded alone, and only one result is built
            got = self.tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
            flat = np.array(got.ids, np.uint32)
            count = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            n = len(self.number)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(part) + 1 > len(self.at):
                self.at, self.mark = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.mark))
            self.ids[self.used:self.used + len(flat)] = flat
            self.at[n + 1:n + 1 + len(part)] = self.used + np.cumsum(count)
            self.mark[n:n + len(part)] = marks[k:k + 4096]
            self.used += len(flat)
            self.number.update(zip(keys[k:k + 4096], range(n, n + len(part))))

    def encode(self, data, offsets):
        """(ids of all rows, the end id after each; row offsets)."""
        rows = len(offsets) - 1
        lower, start, end, row = pieces(data, offsets)
        wide = np.concatenate([lower, np.zeros(8, np.uint8)]).astype(np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((wide[:len(data)] + np.uint64(1)) * powers(len(data)), out=total[1:])
        size = (end - start).astype(np.uint64)
        key, at, of = np.unique(mix((total[end] - total[start]) * inverse_powers(len(data))[start] ^ size),
                                return_index=True, return_inverse=True)
        # length and first bytes tell apart what might share a hash
        mark = size
        for i in range(7):
            mark = mark << np.uint64(8) ^ np.where(end - start > i, wide[start + i], 0).astype(np.uint64)
        names = key.tolist()
        known = [self.number.get(k, -1) for k in names]
        if len(self.number) + known.count(-1) > REMEMBERED:
            self.clear()
            known = [-1] * len(names)
        new = [i for i, k in enumerate(known) if k < 0]
        if new:
            where = at[new]
            self.learn([names[i] for i in new], mark[where],
                       [lower[a:b].tobytes() for a, b in zip(start[where].tolist(), end[where].tolist())])
            for i in new:
                known[i] = self.number[names[i]]
        piece = np.array(known, np.int64)[of]
        if (self.mark[piece] != mark).any():  # two pieces share a hash: the slow way
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(lists), np.uint32)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        else:
            count = self.at[piece + 1] - self.at[piece]
            ends = np.concatenate([[0], np.cumsum(count)])
            flat = self.ids[np.arange(ends[-1]) + np.repeat(self.at[piece] - ends[:-1], count)]
            ends = ends[row]
        return np.insert(flat, ends[1:], END).astype(np.uint32), ends + np.arange(rows + 1)


_encoders = {}


def encoder(path):
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs, tokenizer):
    """doc_id, ids: little-endian ids of each row with the end id, two bytes each where the vocabulary allows."""
    def run(batches):
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                coder = encoder(tokenizer)
                flat, at = coder.encode(data, offsets)
                flat = flat.astype(width(coder.tokenizer.get_vocab_size()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(at) - 1),
                     pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def width(vocabulary):
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(tokens, kind):
    """id, n over all documents, end ids included."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = np.bincount(raw(batch.column("ids").slice(at, 256))[0].view(kind))
                if len(found) > len(total):
                    total, found = found, total
                total[:len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids].astype(np.int64))], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs, tokenizer, path=None):
    """Write the ids of documents (doc_id, text) in ascending doc_id order; returns the folder.

    `tokenizer` is the path of a tokenizers file, the same on every worker.
    Documents are tokenized once; their ids wait in the shared folder until the
    counts are known.

    Defined results: null and empty texts are the end id alone; repeated rows
    are written as often as they come, equal doc_ids side by side; a null
    doc_id comes first. No documents: no blocks. Other columns are passed over.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    waiting = new_path(spark, "token-ids")
    tokenized(docs, tokenizer).write.option("compression", "zstd").parquet(waiting)
    tokens = spark.read.schema("doc_id long, ids binary").parquet(waiting)
    kind = width(encoder(tokenizer).tokenizer.get_vocab_size())
    id_counts(tokens, kind).coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids, sizes, held, n = [], [], [], 0

        def pack():
            flat = np.concatenate(held)
            lanes, states, words = rans.encode(flat, table.value)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first],
                 "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([sizes], pa.list_(pa.int64())),
                 "n_ids": [n], "lanes": pa.array([lanes], pa.int32()), "states": pa.array([states], pa.binary()),
                 "words": pa.array([words], pa.binary()), "crc32": [rans.checksum(flat)]})

        for batch in batches:
            for own, held_ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append(np.frombuffer(held_ids.as_buffer(), kind).astype(np.uint32))
                ids.append(own)
                sizes.append(len(held[-1]))
                n += sizes[-1]
                if n >= BLOCK:
                    yield pack()
                    block, first = block + 1, first + n
                    ids, sizes, held, n = [], [], [], 0
        if n:
            yield pack()

    (tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks"))
    remove(spark, waiting)
    return path


def read_table(spark, path):
    rows = spark.read.parquet(f"{path}/table").collect()  # at most one row for each id of the vocabulary
    return rans.Table([r["id"] for r in rows], [r["n"] for r in rows])


def _decoded(batches, table):
    slots = table.slots()
    for batch in batches:
        for r in batch.to_pylist():
            ids = rans.decode(r["n_ids"], r["lanes"], r["states"], r["words"], table, slots)
            if rans.checksum(ids) != r["crc32"]:
                raise ValueError(f"block {r['block']} of shard {r['shard']}: wrong checksum")
            yield r, ids, np.concatenate([[0], np.cumsum(r["lengths"])])


def _blocks(spark, path):
    """Blocks with `before`: the ids of all shards before theirs."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total, before = 0, []
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # one row a shard
        before.append((r["shard"], total))
        total += r["n"]
    return blocks.join(F.broadcast(spark.createDataFrame(before, "shard int, before long")), "shard")


def read_tokens(spark, path):
    """doc_id, ids of every document."""
    table = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches):
        for r, ids, at in _decoded(batches, table.value):
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, ids array<int>")


def token_index(spark, path):
    """doc_id, start, n_tokens, ids_crc32 of every document, from decoded blocks."""
    table = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches):
        for r, ids, at in _decoded(batches, table.value):
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["before"] + r["first"]), pa.array(r["lengths"], pa.int64()),
                 pa.array([rans.checksum(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
