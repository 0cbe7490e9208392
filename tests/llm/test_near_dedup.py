import random
import re

import numpy as np
import pytest

from twinframe.llm import near_dedup
from twinframe.llm.components import components
from twinframe.llm.near_dedup import BANDS, SIZE, least_matches, near_duplicates


def sets(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    up = {i: i for i in own}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = own[a], own[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return [(i, len(own[i]), root(i), root(i) == i) for i in ids]


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.random()}"
    return " ".join(w)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_like_brute_force(frame, prose):
    texts = [prose(60 + 7 * i, i) for i in range(12)]
    family = prose(150, 99)
    texts += [edited(family, i % 6, i) for i in range(40)]
    texts += [texts[3].upper(), texts[3].replace(" ", "\t\n"), "one two", "One  TWO", "", None, " \n", "É é", "é é", "  x"]
    shared = prose(30, 5)
    texts += [shared + " " + prose(40, 100 + i) for i in range(20)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    assert result(near_duplicates(frame(rows))) == brute(rows)


def test_large_buckets_are_split_without_loss(frame, prose, monkeypatch):
    family = prose(120, 7)
    rows = [(i, edited(family, 2 + i % 9, 50 + i)) for i in range(60)]
    assert result(near_duplicates(frame(rows), small=2)) == brute(rows)
    monkeypatch.setattr(near_dedup, "TOGETHER", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    assert result(near_duplicates(frame(rows), small=2)) == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(spark, frame, prose):
    t = prose(20, 1)
    got = near_duplicates(frame([(5, t), (5, t), (None, t), (7, t)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_duplicates(frame([(1, "x")]).where("doc_id < 0")).collect() == []


def test_scratch_tables_are_deleted(frame, prose, tmp_path, monkeypatch):
    family = prose(120, 7)
    rows = [(i, edited(family, i % 9, 50 + i)) for i in range(30)] + [(40 + i, prose(50, i)) for i in range(5)]
    monkeypatch.setattr("twinframe.shared.shared_dir", lambda spark: str(tmp_path))
    got = near_duplicates(frame(rows), small=2)
    left = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
    assert {"base", "named"} <= left <= {"base", "named", "links", "hooks"}
    assert result(got) == brute(rows)


def test_very_long_text(frame, prose):
    long = prose(30_000, 3)
    rows = [(0, long), (1, edited(long, 500, 1)), (2, edited(long, 9000, 2))]
    assert result(near_duplicates(frame(rows))) == brute(rows)


def test_bayes_bounds():
    least = least_matches(0.75, 1e-6)
    assert len(least) == SIZE // 16 and least == sorted(least)
    # a pair at the threshold is lost with about the chosen probability only
    rng, lost, trials = np.random.default_rng(0), 0, 20_000
    equal = (rng.random((trials, SIZE)) < 0.75).cumsum(1)
    for k, need in enumerate(least):
        lost += (equal[:, 16 * (k + 1) - 1] < need).sum()
    assert lost <= 1
    assert (1 - 0.75 ** 4) ** BANDS < 1e-5


@pytest.mark.parametrize("links,want", [
    ([(1, 2), (2, 3), (9, 8), (4, 4)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}),
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(100, i) for i in range(50)] + [(None, 3)], {**{i: 0 for i in range(50)}, 100: 0}),
    ([], {}),
])
@pytest.mark.parametrize("few", [0, 5, 1000])
def test_components(spark, links, want, few):
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3), few)
    assert {r.id: r.component for r in got.collect()} == want
