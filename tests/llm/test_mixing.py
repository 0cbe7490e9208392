import pytest

from twinframe.llm.mixing import mix, mixed


@pytest.fixture
def corpus(frame):
    texts = [("der die und nicht " if i % 4 == 0 else "the and of not ") * (3 + i % 5) for i in range(80)]
    texts += ["the der and die of und " * 4, "", None]
    return frame(texts)


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame([(i, "de" if i % 4 == 0 else "en", 1) for i in range(20)] + [(0, "zz", 2), (5, None, 3), (None, "de", 4)],
                                 "doc_id long, domain string, text int")


def totals(rows, k):
    return [sum(r.rate * r.n_tokens * r.posterior[i] for r in rows) for i in range(k)]


@pytest.mark.parametrize("weights", [{"de": 0.5, "en": 0.5}, {"de": 0.9, "en": 0.1}, {"de": 0.0, "en": 1.0}])
def test_totals_meet_targets(corpus, labelled, weights):
    rows = mix(corpus, labelled, weights).collect()
    assert len(rows) == 83 and all(r.rate >= 0 for r in rows)
    n = sum(r.n_tokens for r in rows)
    got = totals(rows, 2)
    assert got[0] == pytest.approx(weights["de"] * n, abs=2e-3 * n) and got[1] == pytest.approx(weights["en"] * n, abs=2e-3 * n)
    by = {r.doc_id: r for r in rows}
    assert by[0].domain == "de" and by[1].domain == "en" and by[81].n_tokens == by[82].n_tokens == 0
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


@pytest.mark.parametrize("steps", [1, 5])
def test_what_is_left_is_told(corpus, labelled, steps):
    """Targets that the steps do not reach come back with the gap that is left."""
    rows = mix(corpus, labelled, {"de": 0.97, "en": 0.03}, max_steps=steps).collect()
    n = sum(r.n_tokens for r in rows)
    left = sum(abs(a - b * n) for a, b in zip(totals(rows, 2), (0.97, 0.03))) / n
    assert {r.gap for r in rows} == {rows[0].gap} and rows[0].gap == pytest.approx(left, abs=1e-9)
    met = mix(corpus, labelled, {"de": 0.6, "en": 0.4}).first().gap
    assert met <= 1e-6


def test_least_squares_like_dense_projection(corpus, labelled):
    """The fit leaves no smaller gap than a dense solver's."""
    import numpy as np
    rows = mix(corpus, labelled, {"de": 0.7, "en": 0.3}).collect()
    a = np.array([[r.n_tokens * p for r in rows] for p in ()]) if False else np.array([[r.n_tokens * r.posterior[i] for r in rows] for i in range(2)])
    n = sum(r.n_tokens for r in rows)
    t, x = np.array([0.7, 0.3]) * n, np.ones(len(rows))
    for _ in range(20_000):
        x = np.maximum(0, x - a.T @ (a @ x - t) / np.linalg.norm(a, 2) ** 2)
    assert np.abs(a @ np.array([r.rate for r in rows]) - t).sum() <= np.abs(a @ x - t).sum() + 1e-4 * n


def test_rows_are_repeated_as_copies_say(corpus, labelled):
    rates = mix(corpus, labelled, {"de": 0.8, "en": 0.2})
    copies = {r.doc_id: r.copies for r in rates.collect()}
    got = mixed(corpus, rates)
    assert got.columns == corpus.columns
    rows = got.collect()
    assert len(rows) == sum(copies.values())
    assert all(sum(r.doc_id == i for r in rows) == c for i, c in copies.items())


def test_odd_tables(spark, frame, labelled):
    assert mix(frame([(1, "x")]).where("doc_id > 1"), labelled, {"de": 1.0}).collect() == []
    rows = mix(frame([(1, "a b"), (1, "a b"), (None, "c")]), labelled.where("doc_id > 999"), {"de": 1.0, "en": 0.0}).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 4)]
    with pytest.raises(ValueError):
        mix(frame([]), labelled, {})
