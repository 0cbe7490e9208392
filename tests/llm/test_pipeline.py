import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_decontaminate import brute as contaminated  # noqa: E402
from tests.llm.test_near_dedup import brute as groups  # noqa: E402
from tests.llm.test_token_files import whole  # noqa: E402
from twinframe.llm.mixing import mix  # noqa: E402
from twinframe.llm.queries import WEIGHTS, labelled_domains  # noqa: E402


@pytest.fixture
def sf(spark, prose, tmp_path):
    """Toxic, copied, nearly copied, contaminated and plain documents."""
    rows, labels = [], []
    for i in range(120):
        words = prose(60, i).split()
        if i % 4 == 0:
            words[3], words[9] = "moron", "scumbag"
        rows.append((i, " ".join(words), ["en", "de", "fr", "es"][i % 3], f"src{i % 2}", 0))
        labels.append((i, i % 5 > 0, i % 4 == 0))
    items = [(k, prose(20, 800 + k)) for k in range(4)]
    rows += [(200 + i, prose(20, 900 + i) + " " + items[i % 4][1], "en", "src0", 0) for i in range(8)]
    rows += [(300 + i, rows[1 + i * 4][1] + (" tail" if i % 2 else ""), "en", "src1", 0) for i in range(8)]
    rows += [(None, rows[0][1] + " bare", "en", "src1", 5), (None, rows[5][1], "en", "src1", 5), (None, prose(20, 990) + " " + items[0][1], "en", "src1", 5)]
    rows += [(400, None, "en", None, None), (401, "", None, "src1", 0), (None, "no id", "en", "src1", 5), rows[1]]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def test_stages_take_effect(spark, sf):
    path, rows, items = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {None: docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        seen[name] = docs = spark.read.parquet(f"{path}/{name}")
        if name != "token_files":
            assert docs.columns == seen[None].columns
    ids = {name: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect()) for name, df in seen.items()}
    bare = {name: [r[1] for r in rows if r[0] is None and r[1] in {x.text for x in df.where("doc_id is null").collect()}]
            for name, df in seen.items() if name != "token_files"}
    assert len(bare[None]) == 4 and bare["toxicity"] == bare[None][1:] and bare["near_dedup"] == bare[None][2:]
    assert bare["decontamination"] == ["no id"] and set(bare["mixing"]) <= {"no id"}
    ids["near_dedup"].remove(-1)  # the one with a benchmark passage
    assert set(ids["toxicity"]) == {-1 if r[0] is None else r[0] for r in rows if "moron" not in (r[1] or "")}
    left = {r[0]: r for r in rows if r[0] in ids["toxicity"]}
    kept = [i for i, _, _, keep in groups([(i, r[1]) for i, r in left.items()]) if keep]
    assert ids["near_dedup"] == sorted([*kept, -1])
    clean = contaminated([(i, left[i][1]) for i in kept], items)
    assert ids["decontamination"] == sorted([i for i in kept if not clean[i][0]] + [-1]) and sum(c[0] for c in clean.values()) >= 8
    before = seen["decontamination"]
    rates = mix(before, labelled_domains(before, spark.read.parquet(f"{path}/labels.parquet")), WEIGHTS).collect()
    assert ids["mixing"] == sorted(-1 if r.doc_id is None else r.doc_id for r in rates for _ in range(r.copies))
    texts = {r[0]: r[1] for r in rows}
    start = 0
    for r in sorted(seen["token_files"].collect(), key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (start, len(whole([texts[r.doc_id]])[0]))
        start += r.n_tokens
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in seen["token_files"].collect()) == ids["mixing"]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf[0]).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_few_drops_do_not_shuffle_the_texts(frame):
    rows = [(i, f"text {i}") for i in range(20)] + [(None, "none"), (3, "again")]
    kept = corpus_pipeline._decided(frame(rows), lambda named: named.where("doc_id % 2 = 0"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    assert left == sorted((i, t) for i, t in rows if i is not None and i % 2)
