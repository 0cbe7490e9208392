import hashlib
import random

import numpy as np
import pytest

from twinframe.llm import substrings
from twinframe.llm.substrings import LENGTH, Meeting, removed, suffix_dedup


def brute(rows):
    """By a table of all 100-byte strings, documents in order of id."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - LENGTH + 1):
            w = data[p:p + LENGTH]
            if seen.setdefault(w, (i, p)) != (i, p):
                gone[p:p + LENGTH] = [True] * LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(prose):
    r = random.Random(2)
    passages = [prose(40, 900 + i) for i in range(6)] + ["é" * 80, "ab" * 90, prose(17, 950), "x" * 99, "y" * 100, "z" * 101]
    rows = []
    for i in range(60):
        parts = [prose(r.randrange(1, 25), 1000 * i + k) if r.random() < 0.4 else r.choice(passages) for k in range(r.randrange(1, 7))]
        rows.append((i * 3 - 40, r.choice([" ", "", "\n"]).join(parts)))
    rows += [(500, rows[5][1]), (501, rows[5][1][3:]), (502, None), (503, ""), (504, "short"), (505, "a" * 3000), (506, "a" * 150), (None, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,together", [(2000, 200_000), (1, 50)])
def test_like_brute_force(frame, prose, monkeypatch, hot, together):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "TOGETHER", together)
    rows = corpus(prose)
    assert result(suffix_dedup(frame(rows, 7))) == brute(rows)


def test_many_shared_passages_in_many_partitions(frame, prose):
    shared = prose(60, 1)
    rows = [(i, prose(5, 10 + i) + " " + shared + " " + prose(5, 500 + i)) for i in range(150)]
    assert result(suffix_dedup(frame(rows, 11))) == brute(rows)


def test_repeated_rows_and_no_rows(frame, prose):
    text = prose(60, 1)
    got = suffix_dedup(frame([(1, text), (1, text), (2, text)], 3)).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, False), (2, True)]
    assert suffix_dedup(frame([(1, text)]).where("doc_id > 1")).collect() == []


def test_spans_and_bytes_that_are_kept(frame, prose):
    text = prose(60, 1)
    rows = {r.doc_id: r for r in removed(frame([(1, "start " + text), (2, "other " + text + "!!!")])).collect()}
    assert bytes(rows[2].kept) == b"other!!!" and [tuple(s) for s in rows[2].spans] == [(5, len(text) + 6)]


def test_a_group_over_many_batches():
    """Whatever the cuts between batches, repeats and firsts are the same."""
    rng = np.random.default_rng(3)
    gram, kind, doc = np.sort(rng.integers(0, 12, 300)), rng.integers(0, 3, 300), rng.integers(0, 50, 300)
    start, m = rng.integers(0, 3, 300), np.ones(300, np.int64)
    order = np.lexsort((start, doc, kind, gram))
    rows = [x[order] for x in (gram, kind, doc, start, m)]

    def through(size):
        state, late, heads = Meeting(), [], []
        for at in range(0, 300, size):
            repeat, first = state.step(*(x[at:at + size] for x in rows))
            late += list(repeat)
            heads += list(zip(*first))
        return late, sorted(map(tuple, heads))
    assert through(300) == through(1) == through(7) == through(50)


def test_runs_whose_class_hashes_differ_in_any_bit_are_no_repeats(spark):
    gram, doc, none = np.full(4, 9, np.uint64), np.arange(4), np.zeros(4, np.int64)

    def repeated(kind, **more):
        rows = substrings.batch_of(none, gram, np.array(kind, np.uint64), doc, none, none + 1, 0, **more)
        found = substrings.met(spark.createDataFrame(rows.to_pandas(), substrings.ROW))
        return sorted(r.doc for r in found.where("kind = 1").collect())

    high = 5 << 32
    assert repeated([high + 1, high + 2, high + 3, high + 3]) == [3]
    assert repeated([high] * 4, more=np.array([1, 2, 2, 1], np.uint64)) == [2, 3]
