import hashlib
import random
import zlib

import numpy as np
import pytest

from twinframe.llm import periods
from twinframe.llm.periods import periodic_runs, planted, run_digests, runs_of


def brute_runs(words, exponent=4, least=6):
    """Maximal stretches of every distance; of equal stretches the smallest distance is the period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            letters = "abc"[:r.randint(1, 3)]
            unit = [r.choice(letters) for _ in range(r.randint(1, 12))]
            if r.random() < 0.3:
                unit = unit * r.randint(2, 6) + [r.choice("xyz")]
            parts += (unit * r.randint(1, 9))[:r.randint(1, 120)] + [r.choice("xyzab") for _ in range(r.randint(0, 3))]
        out.append([w.encode() for w in parts])
    return out


@pytest.mark.parametrize("piece", [1, 7, 1 << 15])
@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 4), (4, 6)])
def test_equals_brute_force(monkeypatch, piece, exponent, least):
    monkeypatch.setattr(periods, "PIECE", piece)
    texts = texts_with_runs(exponent * 100 + piece, 25 if piece == 1 else 80)
    assert runs_of(texts, exponent, least) == [brute_runs(t, exponent, least) for t in texts]


def test_known_words():
    fib, thue = ["a", "ab"], "a"
    for _ in range(12):
        fib.append(fib[-1] + fib[-2])
    for _ in range(9):
        thue += thue.translate({97: 98, 98: 97})
    texts = [[c.encode() for c in t] for t in (fib[-1], thue, "a" * 500, "ab" * 300, "aaaab" * 60, "".join(fib[-4] * 5))]
    for exponent, least in ((2, 2), (4, 6)):
        assert runs_of(texts, exponent, least) == [brute_runs(t, exponent, least) for t in texts]
    assert runs_of([texts[1]], 3, 3) == [[]]  # overlap-free


def test_hash_collisions_do_no_harm(monkeypatch):
    monkeypatch.setattr(periods, "mix", lambda x: x & np.uint64(3))
    texts = texts_with_runs(11, 40)
    assert runs_of(texts, 4, 6) == [brute_runs(t) for t in texts]


def brute_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = (None,) * 4
    if runs:
        from fractions import Fraction
        s, l, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, l, q, 1000 * l // q)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_documents(frame, rows, prose):
    texts = [" ".join(w.decode() for w in t) for t in texts_with_runs(5, 40)]
    texts += [prose(r, r) for r in range(1, 60)] + [None, "", " \t\n", "a\x0ba\x0ca\ra a\ta", "é ｅ é", " x ", "a a " * 9]
    texts += ["w " * 6, "w " * 5, "W w " * 4, "one two " * 4 + "one", texts[3], texts[3]]
    docs = frame(texts).unionByName(frame([(None, "z " * 9), (3, texts[3]), (3, texts[3])]))
    want = [brute_row(r.doc_id, r.text) for r in docs.collect()]
    got = run_digests(periodic_runs(planted(docs)))
    assert rows(got) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 20 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))


def test_collapsed_texts(frame):
    got = {r.doc_id: r for r in periodic_runs(frame(["a b  c\n" * 5 + "d", "q", None]), 2, 2).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 15, 3)] and got[0].collapsed == "a b c d"
    assert got[1].collapsed == "q" and got[2].collapsed == "" and got[2].runs == []


def test_very_long_and_no_documents(frame):
    long = "x y " * 150_000 + "z " + " ".join(str(i) for i in range(100_000))
    got = periodic_runs(frame([long, "a"])).where("doc_id = 0").first()
    assert [tuple(x) for x in got.runs] == [(0, 300_000, 2)] and len(got.collapsed.split()) == 100_003
    assert run_digests(periodic_runs(planted(frame([long]).where("doc_id > 5")))).collect() == []
