import math

import numpy as np
import pytest
from pyspark.sql import Row

from twinframe.operators import ranks
from twinframe.operators.ranks import around_rank, interpolated

SETS = {
    "ties": [0.25] * 50 + [-1.0] * 3 + [0.5, 0.75] * 40,
    "one value": [3.5] * 40,
    "one row": [7.0],
    "near": list(1.0 + np.arange(200) * 2.0 ** -52),
    "spread": list(10.0 ** np.arange(-150, 150)),
    "signs": [-0.0, 0.0, -5e-324, 5e-324, 1.0, -1.0] * 5,
    "random": list(np.random.default_rng(4).normal(size=500)),
}


@pytest.mark.parametrize("name", SETS)
def test_every_rank(spark, monkeypatch, name):
    monkeypatch.setattr(ranks, "FEW", 7)
    monkeypatch.setattr(ranks, "BINS", 16)
    data = sorted(SETS[name])
    values = spark.createDataFrame([(float(x),) for x in reversed(data)], "x double").coalesce(2).cache()
    n = len(data)
    ends = Row(low=data[0], high=data[-1], n=n)
    for rank in {0, n // 3, n - 1}:
        assert around_rank(values, "x", rank, ends) == (data[rank], data[rank + 1] if rank + 1 < n else None)
    with pytest.raises(ValueError):
        around_rank(values, "x", n, ends)
    values.unpersist()


@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_between_ranks(spark, share):
    for data in (SETS["random"], SETS["ties"], [1.0, 2.0], [5.0]):
        values = spark.createDataFrame([(float(x),) for x in data], "x double")
        got = interpolated(values, "x", share)
        assert math.isclose(got, np.quantile(data, share), rel_tol=1e-14)
        place = (len(data) - 1) * share
        if len(set(data)) == len(data):
            assert sum(x < got for x in data) == (place if place == int(place) else int(place) + 1)
    assert interpolated(values.where("x > 99"), "x", share) is None
