"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Equal lines (trimmed, lower case) are one node. Each node's character shingles
are hashed once and dealt into MANY bins; the minima of the bins are its
signature, and empty bins take over the minima of others.
Bands of BAND minima propose pairs, two bits of each minimum drop most of the
wrong ones, bitmaps of the shingles drop those that surely are none, and the
full shingle sets decide on the rest. Union-find names components, and of each
component one line stays.
"""

import math
import random
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinframe.llm.buckets import buckets, candidates, outside_pairs, shared_buckets, with_outside
from twinframe.llm.components import components
from twinframe.shared import short_methods, written

SHINGLE, MANY, BAND = 8, 60, 3
BANDS = MANY // BAND
_numbers = random.Random(30)
MASKS = [_numbers.getrandbits(32) - (1 << 31) for _ in range(MANY)]
#: Where an empty place of a signature looks next; after round r it has looked at 2 ** r places.
ORDERS = [_numbers.sample(range(MANY), MANY) for _ in range(8)]
#: Other bands over the same places, for lines with at most SHORT full places, whose shingles often share a bin; of the bits of
#: a pair with such a line so many fewer need agree.
MORE, SHORT, SLACK = _numbers.sample(range(MANY), MANY), 24, 9
#: Pairs of bits in one number of `bits`, and the chance that a pair of lines at the threshold is dropped by them.
IN_ONE, MISS = 30, 1e-6
PAIRS_OF_BITS = sum(1 << 2 * i for i in range(IN_ONE))
#: Lines to fetch that are broadcast rather than shuffled: 16 bytes each, so 4 MB.
BROADCAST_LINES = 1 << 18
#: A bit of `bits0` that says that a line is short.
FLAG = 1 << 2 * IN_ONE
NODE = ["h1", "h2"]
BITS = [f"bits{i}" for i in range(MANY // IN_ONE)]
#: A line's bitmap of its shingles, 64 bits a number; over 100 columns in a join would not be compiled.
MAP = [f"map{i}" for i in range(32)]


def lines(docs):
    """doc_id, position, line (trimmed, lower case), h1, h2 (its identity); blank lines are left out."""
    raw, blank = F.col("raw"), " \t\r"
    # the ends are looked at first, as btrim goes through the whole line
    ends = reduce(Column.__or__, [at(raw, F.lit(c)) for at in (F.startswith, F.endswith) for c in blank])
    line = F.lower(F.when(ends, F.btrim(raw, F.lit(blank))).otherwise(raw))
    return (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "raw"))
            .select("doc_id", "position", line.alias("line")).where("line <> ''")
            .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit("second"))}))


def hashed(rows, *names):
    """The named columns and v, the 32-bit hash, of each shingle of `wide`, a text in UTF-32."""
    last = F.greatest(F.floor(F.octet_length("wide") / 4) - SHINGLE, F.lit(0)).cast("int")
    rows = rows.select(*names, "wide", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return rows.select(*names, F.hash(F.substring(F.col("wide"), 4 * F.col("at") + 1, F.lit(4 * SHINGLE))).alias("v"))


def least_hashes(table):
    """h1, h2, m_0 to m_59 of each distinct line: the least of the shingle hashes that fall into each bin, null where none does."""
    rows = hashed(table.select(*NODE, F.encode("line", "UTF-32").alias("wide")), *NODE)
    rows = rows.select(*NODE, "v", F.pmod("v", F.lit(MANY)).alias("bin"))
    return rows.groupBy(*NODE).agg(*[F.expr(f"min(v) FILTER (WHERE bin = {i})").alias(f"m_{i}") for i in range(MANY)])


def signed(table):
    """h1, h2, BITS, keys of each distinct line: two bits of each place of its signature, and its band keys.

    An empty place of the signature takes the value of the first one that is
    not, in an order of its own; ORDERS hold these orders, each twice as long as that before.
    """
    full = sum((F.col(f"m_{i}").isNotNull().cast("int") for i in range(MANY)), F.lit(0))
    rows = least_hashes(table).select("*", F.least(*[f"m_{i}" for i in range(MANY)]).alias("least"), (full <= SHORT).alias("short"))
    for order in ORDERS:
        rows = rows.select(*NODE, "least", "short", *[F.coalesce(f"m_{i}", f"m_{k}").alias(f"m_{i}") for i, k in enumerate(order)])
    rows = rows.select(*NODE, "short", *[F.coalesce(f"m_{i}", "least", F.lit(0)).alias(f"m_{i}") for i in range(MANY)])
    bits = []
    for at in range(0, MANY, IN_ONE):
        one = F.when(F.col("short") & F.lit(at == 0), F.lit(FLAG)).otherwise(F.lit(0).cast("long"))
        for i in range(IN_ONE):
            # hashed again for each place, as one shingle may stand in many
            of = F.hash(F.col(f"m_{at + i}").bitwiseXOR(F.lit(MASKS[at + i])))
            one = one.bitwiseOR(F.shiftleft(of.cast("long").bitwiseAND(3), 2 * i))
        bits.append(one.alias(f"bits{at // IN_ONE}"))
    base, more = (F.array(*[F.xxhash64(F.lit(at + b), *[f"m_{places[BAND * b + i]}" for i in range(BAND)]) for b in range(BANDS)])
                  for at, places in ((0, range(MANY)), (BANDS, MORE)))
    return rows.select(*NODE, *bits, F.when(F.col("short"), F.concat(base, more)).otherwise(base).alias("keys"))


def least_agreeing(percent):
    """The most of MANY pairs of bits of which a pair at the threshold has fewer with a chance of at most MISS.

    Places are equal with the similarity as their chance, and the bits of others in one case of four.
    """
    p, total, n = percent / 100 + (1 - percent / 100) / 4, 0.0, 0
    while n < MANY:
        total += math.comb(MANY, n) * p ** n * (1 - p) ** (MANY - n)
        if total > MISS:
            break
        n += 1
    return n


def alike(one, other, percent):
    """Whether enough bits of two signatures agree; the names of their columns are those of BITS with a suffix."""
    count = F.lit(MANY)
    for c in BITS:
        off = F.col(f"{c}_{one}").bitwiseXOR(F.col(f"{c}_{other}"))
        count = count - F.bit_count(off.bitwiseOR(F.shiftrightunsigned(off, 1)).bitwiseAND(F.lit(PAIRS_OF_BITS)))
    short = F.col(f"bits0_{one}").bitwiseOR(F.col(f"bits0_{other}")) >= FLAG
    return count >= least_agreeing(percent) - F.when(short, F.lit(SLACK)).otherwise(F.lit(0))


def likely(pairs, nodes, percent):
    """The pairs of which enough bits agree."""
    side = {c: nodes.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in BITS]) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").where(alike("a", "b", percent)).select("a", "b")


def bitmaps(texts):
    """id, many, MAP of (id, many, wide): a bit for each shingle of a line, by its hash."""
    rows = hashed(texts, "id", "many")
    rows = rows.select("id", "many", F.expr("shiftleft(1L, v & 63)").alias("bit"), F.expr(f"(v >> 6) & {len(MAP) - 1}").alias("word"))
    return rows.groupBy("id", "many").agg(*[F.expr(f"coalesce(bit_or(bit) FILTER (WHERE word = {i}), 0L)").alias(c) for i, c in enumerate(MAP)])


def possible(one, other, percent):
    """False only where two lines surely are no link; the names of their columns are `many` and MAP with a suffix.

    A bit that only one of the lines has stands for a shingle or more that only
    this line has. With d of these, all = 2 * both + d, and 100 * both >= percent * (both + d)
    is (100 + percent) * d <= (100 - percent) * all; there are `off` such bits, and off <= d.
    """
    off = sum((F.bit_count(F.col(f"{c}_{one}").bitwiseXOR(F.col(f"{c}_{other}"))) for c in MAP), F.lit(0))
    return (100 + percent) * off <= (100 - percent) * (F.col(f"many_{one}") + F.col(f"many_{other}"))


def numbers(table, names):
    """The table, of which these columns, never null as they are, are known to be none; checks for null make join conditions long."""
    return table.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})


def left_possible(pairs, maps, percent):
    """The pairs that the bitmaps leave."""
    side = {c: maps.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("many", *MAP)]) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").where(possible("a", "b", percent)).select("a", "b")


def shingle_hashes(wide):
    """Hashes of the shingles of a UTF-32 column, repeats included."""
    last = F.greatest(F.octet_length(wide) - 4 * SHINGLE, F.lit(0)) + 1
    # a variable, as each reference to the column itself would copy the whole line
    hashes = F.transform(F.array(wide), lambda line: F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda at: F.xxhash64(F.substring(line, at, F.lit(4 * SHINGLE)))))
    return F.get(hashes, F.lit(0))


def shingle_set(wide):
    """Hashes of the different shingles of a UTF-32 column."""
    return F.array_distinct(shingle_hashes(wide))


def confirm(pairs, texts, percent, folders):
    """The pairs with 100 * both >= percent * either, on full shingle sets."""
    side = {c: texts.select(F.col("id").alias(c), F.col("many").alias(f"many_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab"}
    # written before it is filtered, or the filter would make each set several times
    sizes = written(pairs.join(side["a"], "a").join(side["b"], "b")
                    .select("a", "b", F.size(F.array_intersect(shingle_hashes("wide_a"), shingle_hashes("wide_b"))).alias("both"),
                            (F.col("many_a") + F.col("many_b")).alias("all")), "line-sizes", folders)
    return sizes.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def joined(pairs, links, texts, percent, folders):
    """`links` and those of the pairs that name the same components with them as all links among the pairs would.

    Each line's pair with its smallest partner is decided first; of the others
    only those between two components are.
    """
    first = pairs.groupBy("a").agg(F.min("b").alias("b")).union(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    first = written(first.distinct(), "line-first", folders)
    found = confirm(first, texts, percent, folders)
    links = links.union(found) if links is not None else found
    roots = written(components(links), "line-roots", folders)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for c in "ab":
        rest = rest.join(roots.select(F.col("id").alias(c), F.col("component").alias(f"root_{c}")), c, "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return links.union(confirm(written(rest, "line-rest", folders), texts, percent, folders))


def fetch(docs, ids, nodes, folders):
    """(id, wide, many) of the lines with these ids: the line in UTF-32, and how many different shingles it has."""
    ids = written(ids.distinct().join(nodes.select("id", *NODE), "id"), "line-ids", folders)
    few = ids.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    wanted = lines(docs).join(F.broadcast(ids) if few else ids, NODE)
    # written as UTF-32, or each shingle would encode the whole line again
    return written(wanted.groupBy("id").agg(F.any_value("line").alias("line")).select("id", F.encode("line", "UTF-32").alias("wide"))
                   .select("id", "wide", F.size(shingle_set("wide")).cast("long").alias("many")), "lines", folders, compression="zstd")


def line_links(docs, percent, small, few, folders):
    """(nodes, roots): distinct lines as id, h1, h2, and id, component of those with links."""
    with ExitStack() as first:
        with short_methods(docs.sparkSession):
            made = written(signed(lines(docs)).withColumn("id", F.monotonically_increasing_id()), "signed", first)
        members = written(shared_buckets(made.select(F.explode("keys").alias("key"), "id")), "line-buckets", folders)
        # without the keys, most of its bytes, which have no reader any more
        nodes = written(made.select("id", *NODE, *BITS), "line-nodes", folders)
    found = written(likely(candidates(members, small), nodes, percent), "line-pairs", folders)
    # with the lines that the large buckets may compare, as each look at the documents parts them into lines again
    large = members.where(F.col("n") > small)
    texts = fetch(docs, found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).union(large.select("id")), nodes, folders)
    maps = numbers(written(bitmaps(texts), "line-maps", folders), ["many", *MAP])
    found = written(left_possible(found, maps, percent), "line-pairs", folders)
    links = joined(found, None, texts, percent, folders)
    roots = written(components(links), "line-roots", folders)
    large = buckets(large.select("key", "id"), roots, folders)
    large = written(with_outside(large).join(nodes.select("id", *BITS), "id").join(maps, "id"), "line-large", folders)
    if not large.isEmpty():
        more = [*BITS, "many", *MAP]
        decided = alike("one", "two", percent) & possible("one", "two", percent)
        found = written(outside_pairs(numbers(large, more), few, more, decided), "line-pairs", folders)
        roots = written(components(joined(found, links, texts, percent, folders)), "line-roots", folders)
    return nodes.select("id", *NODE), roots


def duplicate_lines(docs, percent=75, small=8, few=256):
    """doc_id, position, component, kept of every line of documents (doc_id, text) that is not blank.

    Lines are linked when 100 * intersection >= percent * union of their sets of
    SHINGLE-character shingles (a shorter line is one shingle); of a component
    the line with the smallest doc_id, and there the first, is kept.

    Defined results: lines end at line feeds; blank lines are no lines here, so
    null and empty texts have none. Rows of one doc_id are copies, of which the
    same lines are kept; a null doc_id comes first. Other columns are passed over.

    A pair at 75 % shares no band about once in 60,000, and the bits drop it with a
    chance of about MISS; README has the figures of a simulation by size.
    Every bucket is decided in full, whatever its size; small and few (see
    `outside_pairs`) are plan settings. Scratch tables go when their last reader
    is done; one narrow one stays for the result.
    """
    docs = docs.select("doc_id", "text")
    with ExitStack() as folders:
        nodes, roots = line_links(docs, percent, small, few, folders)
        named = nodes.join(roots, "id", "left").select(*NODE, F.coalesce("component", "id").alias("component"))
        own = written(lines(docs).select("doc_id", "position", *NODE).join(named, NODE).drop(*NODE), "line-places")
    first = own.groupBy("component").agg(F.min(F.struct("doc_id", "position")).alias("first"))
    return (own.join(first, "component")
            .select("doc_id", "position", "component", F.struct("doc_id", "position").eqNullSafe(F.col("first")).alias("kept")))


def line_dedup(docs, percent=75):
    """doc_id, n_lines, n_removed, removed (positions, ascending) of each distinct doc_id; see `duplicate_lines`."""
    found = (duplicate_lines(docs, percent).where("not kept").groupBy("doc_id")
             .agg(F.array_sort(F.collect_set("position")).alias("removed")))
    found = found.select(F.col("doc_id").alias("other"), "removed")
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.max(F.coalesce(feeds + 1, F.lit(0))).cast("long")
    rows = docs.groupBy("doc_id").agg(n.alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return (rows.join(found, rows["doc_id"].eqNullSafe(F.col("other")), "left")
            .select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")))


def without_lines(docs, dedup):
    """The rows of documents without the lines that `line_dedup` removes."""
    gone = dedup.where("n_removed > 0").select(F.col("doc_id").alias("gone_id"), F.col("removed").alias("gone_lines"))
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("gone_lines"), i)), "\n")
    return rows.select(*[F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c]
                         for c in docs.columns])
