import hashlib
import random
import re

import pytest

from twinframe.llm import exact_index
from twinframe.llm.cuckoo import CuckooFilter
from twinframe.llm.exact_index import delete, duplicates, empty_index, exact_dedup, insert


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_holds_what_is_live():
    f, live, r = CuckooFilter(), set(), random.Random(3)
    for step in range(30_000):
        k = key(r.randrange(6_000))
        if k in live and r.random() < 0.5:
            assert f.delete(k)
            live.remove(k)
        elif f.find(k) < 0:
            assert k not in live
            f.insert(k)
            live.add(k)
    assert len(f) == len(live) and all(f.find(k) >= 0 for k in live)
    assert all(f.find(key(i)) < 0 for i in range(6_000, 9_000)) and not f.delete(key(7_000))
    again = CuckooFilter(*f.stored())
    assert again.stored() == f.stored() and all(again.find(k) >= 0 for k in live)


def test_equal_fingerprints_are_told_apart(monkeypatch):
    keys = [bytes(8) + b"\0\7" + bytes([i]) * 22 for i in range(8)]  # one fingerprint, one pair of buckets
    f = CuckooFilter(16)
    for i, k in enumerate(keys):
        assert f.find(k) < 0
        f.insert(k)
        assert [f.find(x) >= 0 for x in keys] == [j <= i for j in range(8)]
    f.delete(keys[3])
    assert f.find(keys[3]) < 0 and f.find(keys[4]) >= 0


def test_overflow_grows_from_the_keys():
    f, sizes = CuckooFilter(), set()
    for i in range(5_000):
        f.insert(key(i))
        sizes.add(f.n_buckets)
    assert len(sizes) > 8 and len(f) == 5_000 and all(f.find(key(i)) >= 0 for i in range(5_000))
    assert len(f) > 0.4 * len(f.prints)


def brute(pairs):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in pairs]
    groups = {}
    for (i, _), t in zip(pairs, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(pairs, norm):
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


TEXTS = ["a b", "a\t\n b", " a b", "a b ", "", None, " ", "\n\n", "A b", "a b", "é", "é", "x" * 300_000, "x" * 300_000 + " ", "a  b"]


@pytest.fixture
def pairs(prose):
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(4, i % 30)) for i in range(90)]
    return out + [(-5, "a b"), (None, "a b"), (None, "only null"), (None, "only  null"), (3, "a b "), (7, "\n\n")]


@pytest.mark.parametrize("window", [1, 1 << 25])
def test_equals_brute_force(frame, rows, pairs, monkeypatch, window):
    monkeypatch.setattr(exact_index, "WINDOW", window)
    assert rows(exact_dedup(frame(pairs))) == brute(pairs)


def test_heavy_digests(frame, rows, monkeypatch):
    monkeypatch.setattr(exact_index, "HOT", 3)
    monkeypatch.setattr(exact_index, "HEAVY", 10)
    pairs = [(i, "same" if i % 3 else f"own {i // 2}") for i in range(200)]
    assert rows(exact_dedup(frame(pairs, 5))) == brute(pairs)


def test_inserts_and_deletions(spark, frame, rows, pairs, monkeypatch):
    monkeypatch.setattr(exact_index, "SHARDS", 4)
    index = empty_index(spark, 10)
    first, second = pairs[:50], pairs[50:]
    index = insert(index, frame(first))
    assert rows(duplicates(index)) == brute(first)
    index = insert(index, frame(second))
    assert rows(duplicates(index)) == brute(pairs)
    gone = [0, -5, 4, 12, None, *range(100, 160), 9_999]
    index = delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [p for p in pairs if p[0] not in gone]
    assert rows(duplicates(index)) == brute(left)
    live = {hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).digest() for _, t in left}
    held = [CuckooFilter(r.n_buckets, bytes(r.prints), bytes(r.keys)) for r in index.table("filters").collect()]
    assert sorted(k for f in held for k in f.keys if k) == sorted(live)
    assert sorted(bytes(r.digest) for r in index.table("contents").collect()) == sorted(live)
    back = [(i, t) for i, t in pairs if i in gone]
    index = insert(index, frame(back))
    assert rows(duplicates(index)) == brute(pairs)


def test_one_digest_for_two_texts_ends_the_job(spark, frame, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_index.F, "sha2", lambda c, n: F.hex(F.lit(b"z" * 32)))
    with pytest.raises(Exception, match="two texts of one SHA-256"):
        exact_dedup(frame([(1, "a"), (2, "b")], 2))


def test_no_documents(spark, frame):
    assert exact_dedup(frame([(1, "a")]).where("doc_id > 5")).collect() == []
    index = insert(empty_index(spark, 0), frame([(1, "a")]).where("doc_id > 5"))
    assert duplicates(delete(index, spark.createDataFrame([(1,)], "doc_id long"))).collect() == []
    index = insert(index, frame([(1, "a"), (2, "a")]))
    assert duplicates(index).where("kept").count() == 1
