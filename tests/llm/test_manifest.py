import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from twinframe.llm import manifest
from twinframe.llm.manifest import document_manifest, fold, leaf_digest, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels from the leaves to the one last node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1:run + 3]))
        at //= 3
    return out


def brute(docs):
    def leaf(doc_id, text, lang, source, n):
        return h(*map(encoded, (doc_id, source, lang, n, text)))
    groups = {}
    for i, text, lang, source, n, *_ in docs:
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((i, leaf(i, text, lang, source, n), leaf(i, cut, lang, source, n)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(climb([r[1] for r in groups[s]]))
    top, out = climb([t[-1][0] for t in trees]), []
    for k, s in enumerate(order):
        for at, (i, leaf_, cut) in enumerate(groups[s]):
            proof, node = siblings(trees[k], at) + siblings(top, k), cut
            for left, right in proof:
                node = h(*left, node, *right)
            out.append((i, leaf_, trees[k][-1][0], top[-1][0], h(*[x for l, r in proof for x in l + r]), node, node == top[-1][0]))
    return out


@pytest.fixture
def docs(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(parts)
    return make


def rows_of(n, sources):
    return [(i * 7 - 5, f"text\n{i}" if i % 3 else f"é{i}", None if i % 11 == 0 else "en", sources[i % len(sources)], i or None)
            for i in range(n)]


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_equals_brute_force(docs, rows, monkeypatch, steps):
    monkeypatch.setattr(manifest, "STEPS", steps)
    data = rows_of(100, ["a"] * 9 + ["b", "é", None, "", "Z"]) + [(900 + i, "t", "en", f"only{i}", 1) for i in range(6)]
    data += [(None, None, None, None, None), (None, "x\ny", None, None, 3), (2, "same\n", "en", "a", 1), (2, "same\n", "en", "a", 1)]
    data += [(-4, "l\n" * 100_000, "en", "a", 5), (-6, "", "en", "a", 0)]
    assert rows(document_manifest(docs(data))) == sorted(brute(data), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_odd_sizes(docs, rows, n):
    data = rows_of(n, ["only"])
    assert rows(document_manifest(docs(data))) == sorted(brute(data), key=repr)


def test_no_documents(docs):
    assert document_manifest(docs(rows_of(3, ["a"])).where("doc_id > 99")).collect() == []


def test_other_width_and_columns(docs):
    leaves = docs(rows_of(40, ["a", "a", "b"])).select("doc_id", "source", F.col("n_chars").alias("kept"), leaf_digest("text").alias("leaf"))
    found = merkle_manifest(leaves, "source", ["doc_id"], width=5)
    assert found.columns == ["doc_id", "source", "kept", "leaf", "subroot", "root", "proof"]
    got = found.withColumn("up", fold(F.col("leaf"), F.col("proof"))).agg(
        F.count("*").alias("n"), F.count_if(F.col("up") == F.col("root")).alias("ok"), F.count_distinct("root").alias("roots")).first()
    assert (got.n, got.ok, got.roots) == (40, 40, 1)
