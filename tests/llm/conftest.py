import random

import pytest

pytest.importorskip("twinframe.llm")

SYLLABLES = "the on er th re ing tion and of to in st ou ha he".split()


@pytest.fixture
def prose():
    """prose(n, seed): n invented words."""
    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))
    return make


@pytest.fixture
def frame(spark):
    """frame(texts or (id, text) pairs): documents with clashing extra columns, over several partitions."""
    def make(texts, parts=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "x", i or 0, b"y") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, key string, id long, digest binary").repartition(parts)
    return make
