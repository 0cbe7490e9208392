"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The patterns find the base spans. Their contexts (the two words before, and the
words around) are patterns of a second kind: a context in which mostly known
entities stand makes other identifiers there credible, and these make further
contexts credible. Contexts and instances form a graph that Spark scores over
several rounds. How often a context occurs at all is counted over all words of
all documents, so contexts that any word may fill score low.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.llm.text import ROOT, chunks, mix, word_bounds, words
from twinframe.shared import written

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# no match can begin inside a run of digits, so only the first digit of a run is tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Punctuation at the edges of an identifier that is no part of it.
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]<>{}"
#: What a discovered identifier has inside that plain words have not: a digit, or a sign between other characters.
SIGNS = np.zeros(256, bool)
SIGNS[list(b"@_+%=/.()[]{}<>\\")] = True
UNLIKE_WORDS = re.compile(r"[0-9]|.[@_+%=/.()\[\]{}<>\\].", re.DOTALL)
#: The filter of induced contexts: 4 MB, whatever their number.
FILTER_BITS = 25
SPAN = "struct<kind: int, start: int, end: int, before: long, around: long, value: long>"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text):
    """Leftmost matches: each "@" with a domain after it, and before it all that may precede since the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in LOCAL:
            first -= 1
        found = DOMAIN.match(text, at) if first < at else None
        if found:
            yield first, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text):
    """(kind, start, end) in code points, by kind and then by start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def units(data, offsets):
    """Words, with runs of words that hold digits as one: (first byte, end byte, row, is unlike a plain word, before, around).

    `before` hashes the two words before a unit and `around` the words next to
    it; 0 where the row has no such words.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),) + (np.zeros(0, np.uint64),) * 2
    start, end = word_bounds(data, offsets)
    word, at = words(data, offsets, (start, end))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    count = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    digit = count[end] > count[start]
    joins = np.zeros(len(word), bool)
    joins[1:] = digit[1:] & digit[:-1] & (row[1:] == row[:-1])
    signs = np.concatenate([[0], np.cumsum(SIGNS[data])])
    unlike = digit | (signs[np.maximum(end - 1, start)] > signs[np.minimum(start + 1, end)])
    first = np.flatnonzero(~joins)
    last = np.append(first[1:], len(word)) - 1
    begin, finish = at[row[first]], at[row[first] + 1]
    padded = np.concatenate([np.zeros(2, np.uint64), word, np.zeros(1, np.uint64)])
    before = mix(mix(padded[first] * ROOT + padded[first + 1]) + np.uint64(1)) | np.uint64(1)
    around = mix(mix(padded[first + 1] * ROOT + padded[last + 3]) + np.uint64(2)) | np.uint64(1)
    before[first - 2 < begin] = 0
    around[(first - 1 < begin) | (last + 1 >= finish)] = 0
    return start[first], end[last], row[first], unlike[first], before, around


def value_of(text):
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def base_table(docs):
    """doc_id, tie (hash of the text), spans with contexts, of every row."""
    def run(batches):
        for batch in batches:
            for row0, data, offsets in chunks(batch.column("text")):
                n, out, parts = len(offsets) - 1, [], None
                for i in range(n):
                    text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    found = []
                    for kind, a, b in base_spans(text):
                        parts = parts or units(data, offsets)
                        byte = offsets[i] + len(text[:a].encode())
                        u = int(np.searchsorted(parts[0], byte, "right")) - 1
                        found.append({"kind": kind, "start": a, "end": b, "before": int(parts[4][u].view(np.int64)),
                                      "around": int(parts[5][u].view(np.int64)), "value": value_of(text[a:b])})
                    out.append(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row0, n), batch.column("tie").slice(row0, n), pa.array(out, SPANS)],
                    ["doc_id", "tie", "spans"])

    return docs.mapInArrow(run, f"doc_id long, tie long, spans array<{SPAN}>")


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.int64()),
                            ("around", pa.int64()), ("value", pa.int64())]))


def filter_of(patterns):
    """The filter of pattern hashes as bytes; at most 2^FILTER_BITS bits reach the driver."""
    place = F.explode(F.array("pattern", F.shiftrightunsigned("pattern", 32))).alias("place")
    bits = (patterns.select(place).select(F.col("place").bitwiseAND((1 << FILTER_BITS) - 1).alias("place"))
            .groupBy(F.shiftright("place", 5).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def occurrences(docs, bits, shortest):
    """Where the contexts in the filter occur.

    Rows with `n`: how often a task saw the pattern. Rows without: units unlike
    plain words, of at least `shortest` characters, that hold no base span, as
    pattern, doc_id, tie, start, end, value.
    """
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def passes(hashes):
        out = hashes != 0
        for shift in (0, 32):
            place = (hashes >> np.uint64(shift)) & mask
            out &= (bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def run(batches):
        seen = {}
        for batch in batches:
            ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            rows = []
            for row0, data, offsets in chunks(batch.column("text")):
                start, end, row, unlike, before, around = units(data, offsets)
                texts = {}
                for contexts in (before, around):
                    hit = np.flatnonzero(passes(contexts))
                    for p, n in zip(*np.unique(contexts[hit], return_counts=True)):
                        p = int(p.view(np.int64))
                        seen[p] = seen.get(p, 0) + int(n)
                    for u in hit[unlike[hit]]:
                        i = int(row[u])
                        if i not in texts:
                            text = data[offsets[i]:offsets[i + 1]].tobytes()
                            texts[i] = text, base_spans(text.decode("utf-8", "replace"))
                        text, known = texts[i]
                        a = len(text[:start[u] - offsets[i]].decode("utf-8", "replace"))
                        own = text[start[u] - offsets[i]:end[u] - offsets[i]].decode("utf-8", "replace")
                        a += len(own) - len(own.lstrip(EDGES))
                        own = own.strip(EDGES)
                        b = a + len(own)
                        if len(own) >= shortest and UNLIKE_WORDS.search(own) and not any(a < y and x < b for _, x, y in known):
                            rows.append((int(contexts[u].view(np.int64)), None, ids[row0 + i], ties[row0 + i], a, b, value_of(own)))
            yield table(rows)
            if len(seen) > 200_000:
                yield table([(p, n, None, None, None, None, None) for p, n in seen.items()])
                seen = {}
        yield table([(p, n, None, None, None, None, None) for p, n in seen.items()])

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = ["pattern", "n", "doc_id", "tie", "start", "end", "value"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    return docs.mapInArrow(run, "pattern long, n long, doc_id long, tie long, start int, end int, value long")


def discovered(docs, base, rounds=3, min_seeds=3, confidence=0.7, shortest=5):
    """doc_id, tie, found: spans (kind, start, end) of identifiers that credible contexts name.

    A pattern's confidence is the credible share of all its occurrences: seeds
    count 1, other instances their score, and two more occurrences are imagined
    that are not credible. An instance's score is the chance that at least one
    of its patterns is right. After `rounds` rounds, patterns of at least
    `confidence` and `min_seeds` different seeds name their instances. These have
    at least `shortest` characters and a digit inside, or a sign as in
    jane(at)example or bob@localhost; plain words are none in any context.
    """
    spark = docs.sparkSession
    seeds = base.select(F.explode("spans").alias("s")).select(
        F.explode(F.array("s.before", "s.around")).alias("pattern"), "s.kind", "s.value").where("pattern <> 0")
    seeds = seeds.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n"))
    by_kind = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
    patterns = written(by_kind.groupBy("pattern").agg(F.sum("different").alias("different"), F.sum("n").alias("seeds"),
                                                      F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
                       .where(F.col("different") >= min_seeds), "patterns")
    bits = spark.sparkContext.broadcast(filter_of(patterns))
    seen = written(occurrences(docs, bits, shortest), "occurrences")
    totals = seen.where("n is not null").groupBy("pattern").agg(F.sum("n").alias("total"))
    graph = written(patterns.join(totals, "pattern").select("pattern", "kind", "seeds", "total"), "graph")
    mentions = seen.where("n is null").drop("n")
    edges = written(mentions.groupBy("pattern", "value").agg(F.count("*").alias("n")).join(graph.select("pattern"), "pattern"), "edges")
    share = graph.select("pattern", "kind", (F.col("seeds") / (F.col("total") + 2)).alias("confidence"))
    for _ in range(rounds):
        score = (edges.join(share, "pattern").groupBy("value")
                 .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")))
        more = edges.join(score, "value").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("more"))
        share = written(graph.join(more, "pattern", "left").select(
            "pattern", "kind", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("total") + 2)).alias("confidence")), "shares")
    named = mentions.join(share.where(F.col("confidence") >= confidence), "pattern")
    best = named.groupBy("doc_id", "tie", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))


def private_spans(docs, **options):
    """doc_id, base, spans of every row of documents: arrays of (kind, start, end), by kind (as in KINDS) and start.

    `base` holds the pattern matches; `spans` also what `discovered` adds, which
    never overlaps them. Positions are code points, the end exclusive.

    Defined results: a null text is empty and has no spans. Repeated rows have
    the same spans each; rows of one doc_id but different texts are told apart.
    A null doc_id is kept. Without seeds nothing is discovered. Other columns
    are passed over.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    base = written(base_table(docs), "base-spans")
    found = discovered(docs, base, **options)
    found = found.select(F.col("doc_id").alias("other_id"), F.col("tie").alias("other_tie"), "found")
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = base.join(found, base["doc_id"].eqNullSafe(F.col("other_id")) & (base["tie"] == F.col("other_tie")), "left")
    return rows.select("doc_id", F.array_sort(plain).alias("base"),
                       F.array_sort(F.when(F.col("found").isNull(), plain).otherwise(F.concat(plain, "found"))).alias("spans"))


def written_out(spans):
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def private_data(docs, **options):
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row; see `private_spans`."""
    rows = private_spans(docs, **options)

    def count(kind):
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(written_out(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                       written_out(F.col("spans")).alias("spans"))
