import hashlib

import numpy as np
import pytest

from twinframe.llm.fingerprints import (
    CLASS, FULL, KINDS, LEVELS, STEPS, chain, edit, entropy_levels, features, fingerprints, likeness, rarity)
from twinframe.llm.text import raw
import pyarrow as pa


def test_neighbours_and_edits(frame, prose):
    texts = [prose(20 + 13 * i, i) for i in range(40)] + ["", None, "é", "kurz", prose(5000, 77), "ab"]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(7, texts[9])]
    got = fingerprints(frame(rows, 5)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    want = sorted((i, len(t), hashlib.sha256((t[:len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][:len(t) // 3]).encode()).hexdigest())
                  for k, (i, t) in enumerate(order))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    twins = [r for r in got if r.doc_id == 7]
    assert len(twins) == 2 and twins[0].fingerprint == twins[1].fingerprint and 1.0 in (twins[0].near_next, twins[1].near_next)
    long = [r for r in got if r.n_chars > 400 and r.doc_id != 7]
    assert np.mean([r.near_edited for r in long]) > 0.45 and np.mean([r.near_next for r in long]) < 0.1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[100].fingerprint == by[103].fingerprint == ""


def test_odd_tables(frame):
    assert fingerprints(frame([(1, "x")]).where("doc_id > 1")).collect() == []
    one = fingerprints(frame([(1, "abcdef")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    got = fingerprints(frame([(None, "last"), (5, "first one")])).collect()
    assert {r.doc_id: r.edited_sha256 for r in got}[5] == hashlib.sha256(edit("first one", "last").encode()).hexdigest()


def test_chains_grow_and_texts_do_not_mix(prose):
    rank = rarity(np.arange(LEVELS))
    texts = [prose(4000, 1), prose(30, 2), "", prose(300, 3)]
    together = chain(*raw(pa.array(texts)), rank)
    assert len(together[0]) > 3 and len(together[2]) == 0
    for t, c in zip(texts, together):
        assert (chain(*raw(pa.array([t])), rank)[0] == c).all() and likeness(c, c) == 1.0
    assert max(np.bitwise_count(together[0]).sum(1)) <= 5 * FULL


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("", "x", 0.0), ("x", "x", 1.0)])
def test_empty_chains(a, b, want):
    rank = rarity(np.zeros(LEVELS))
    x, y = (chain(*raw(pa.array([t])), rank)[0] for t in (a, b))
    assert likeness(x, y) == want


def brute_features(text, rank):
    """Windows rarer than their neighbours, one window at a time."""
    from twinframe.llm.text import ROOT, mix
    data, out = text.encode(), []
    for i, (size, near, least, most) in enumerate(KINDS):
        if not least <= len(text) < most or len(data) < size:
            continue
        keys = []
        for at in range(len(data) - size + 1):
            window = data[at:at + size]
            counts = np.bincount(CLASS[np.frombuffer(window, np.uint8)])
            share = counts[counts > 0] / size
            level = int(np.clip(np.rint(100 * -(share * np.log2(share)).sum()), 0, STEPS - 1)) + i * STEPS
            number = sum((c + 1) * pow(int(ROOT), k, 1 << 64) for k, c in enumerate(window)) % (1 << 64)
            h = int(mix(np.array([number], np.uint64))[0])
            keys.append((int(rank[level]) << 32 | h >> 32, h))
        for at, (key, h) in enumerate(keys):
            if all(key < k for k, _ in keys[max(at - near, 0):at]) and all(key <= k for k, _ in keys[at + 1:at + near + 1]):
                out.append(h)
    return out


def test_features_of_every_start(prose):
    """All windows count, in texts of every length, whatever stands beside them."""
    rank = rarity(np.random.default_rng(2).permutation(LEVELS))
    texts = [prose(3, 1), prose(70, 2), "é" * 90, "ab" * 300, prose(30, 3), "", "short", "12345678", prose(45, 4) + "\n\t" + "x" * 80, prose(200, 5)]
    found, of = features(*raw(pa.array(texts)), rank)
    for i, t in enumerate(texts):
        want = brute_features(t, rank)
        if len(t.encode()) >= 8:
            assert sorted(found[of == i].tolist()) == sorted(want) and want
        else:
            assert (of == i).sum() == bool(t)


def test_entropy_of_every_window():
    data = np.random.default_rng(1).integers(32, 127, 3000).astype(np.uint8)
    data[500:900] = 97
    for size in (8, 64):
        want = []
        for at in range(len(data) - size + 1):
            share = np.bincount(CLASS[data[at:at + size]]) / size
            want.append(-(share[share > 0] * np.log2(share[share > 0])).sum())
        assert np.abs(entropy_levels(data, size) - 100 * np.array(want)).max() <= 0.5001


def test_short_texts_are_like_their_edits(frame, prose):
    texts = [prose(5 + i % 110, i) for i in range(500)]
    got = [r for r in fingerprints(frame(texts, 4)).collect() if r.n_chars >= 30]
    for low, high in ((30, 60), (60, 120), (120, 171), (171, 256), (256, 384), (384, 600)):
        part = [r for r in got if low <= r.n_chars < high]
        near, other = np.mean([r.near_edited for r in part]), np.mean([r.near_next for r in part])
        assert len(part) > 15 and near > 0.4 and near > 3 * other, (low, near, other)
