import pytest

from twinframe.operators import compare, hash_tree, keys
from twinframe.operators.hash_tree import differing_leaves, row_differences, tree_leaves


@pytest.fixture
def side(spark):
    def make(change=None, drop=(), more=()):
        rows = [(i % 40 or None, f"k{i // 40}", f"v{i}", i / 7, None if i % 9 == 0 else i) for i in range(800)]
        rows = [change(*r) if change else r for r in rows if (r[0], r[1]) not in drop] + list(more)
        return spark.createDataFrame(rows, "a int, b string, v string, x double, n bigint").repartition(3)
    return make


def plain(source, target, rows):
    hashes = compare.row_hashes(keys.key_pair(source, target, ["a", "b"], how="inner"))
    return rows(hashes.where("source_hash <> target_hash").select("pk", "source_hash", "target_hash"))


@pytest.mark.parametrize("leaves,width", [(1 << 16, 16), (64, 4), (1, 16)])
def test_like_comparing_all_rows(side, rows, monkeypatch, leaves, width):
    monkeypatch.setattr(hash_tree, "LEAVES", leaves)
    monkeypatch.setattr(hash_tree, "WIDTH", width)
    source = side()
    changes = [lambda a, b, v, x, n: (a, b, v + "!" if a == 3 else v, x, n), lambda a, b, v, x, n: (a, b, v, None if b == "k2" and a is None else x, n),
               lambda a, b, v, x, n: (a, b, v, x, 0 if n is None and a == 9 else n)]
    for change in changes if leaves == 64 else changes[:1]:
        target = side(change, drop={(5, "k1")}, more=[(99, "new", "v", 1.0, 1), (7, "k0", "a", 0.5, 1)])
        assert rows(row_differences(source, target, ["a", "b"])) == plain(source, target, rows) != []


def test_equal_data_joins_no_rows(side):
    source, target = side(), side().orderBy("v")
    own = keys.join_keys(source, target, ["a", "b"])
    columns = sorted(source.columns)
    nodes, compared = differing_leaves(*(tree_leaves(df, cols, columns) for df, cols in zip((source, target), own)))
    assert (nodes, compared) == ([], 1)
    found = row_differences(source, target, ["a", "b"])
    assert found.collect() == []
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text  # an empty list of leaves leaves nothing to join


def test_only_differing_branches_are_opened(side):
    source, target = side(), side(lambda a, b, v, x, n: (a, b, "other" if (a, b) == (8, "k3") else v, x, n))
    own = keys.join_keys(source, target, ["a", "b"])
    nodes, compared = differing_leaves(*(tree_leaves(df, cols, sorted(source.columns)) for df, cols in zip((source, target), own)))
    assert len(nodes) == 1 and compared == 1 + 4 * 16
