import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import rans, token_files
from twinframe.llm.queries import tokenizer_path
from twinframe.llm.text import raw
from twinframe.llm.token_files import read_tokens, token_index, write_tokens


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 3), (5000, 1), (5000, 4000), (300_000, 900)])
def test_range_coder_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = (rng.zipf(1.3, n) % top * 13).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    table = rans.Table(found, counts)
    assert not n or int(table.freq.sum()) == 1 << rans.BITS
    lanes, states, words = rans.encode(ids, table)
    assert (rans.decode(n, lanes, states, words, table, table.slots()) == ids).all()
    if n > 1000 and top > 1:
        p = counts / n
        assert len(words) < 1.02 * (-(p * np.log2(p)).sum() * n / 8) + 4 * lanes + 64


def test_rare_ids_keep_a_slot():
    table = rans.Table(range(40_000), [1] * 39_999 + [10 ** 12])
    assert int(table.freq.sum()) == 1 << rans.BITS and table.freq.min() >= 1


def whole(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


TEXTS = ["Hello, World!  it's\tÓk", "", None, "a b ́ x", "<|endoftext|> y <|startoftext|>z", "ΣΑΣ ΣΑΣ. ÇA l'\"1\"", "\x0b\x0c\r\n", "x" * 5000]


def test_files_hold_what_the_tokenizer_says(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    texts = TEXTS + [prose(50 + 10 * i, i) for i in range(30)]
    order = list(enumerate(texts))[::-1] + [(3, texts[3]), (None, "no id")]
    path = write_tokens(frame(order), tokenizer_path())
    want = sorted(((-1 if i is None else i), x) for (i, _), x in zip(order, whole([t for _, t in order])))
    got = [(-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in read_tokens(spark, path).collect()]
    assert sorted(got) == want
    start, index = 0, []
    for i, ids in want:
        index.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32)
                  for r in token_index(spark, path).collect()) == index


def test_no_documents(spark, frame):
    path = write_tokens(frame([(1, "x")]).where("doc_id > 1"), tokenizer_path())
    assert token_index(spark, path).collect() == []


def test_damage_is_noticed(spark, frame, prose):
    path = write_tokens(frame([prose(400, 1)]), tokenizer_path())
    blocks = spark.read.parquet(f"{path}/blocks").selectExpr("* except (crc32)", "crc32 + 1 as crc32")
    blocks.write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="wrong checksum"):
        token_index(spark, f"{path}-bad").collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'sSZ19.,<|>\u00e9\u00d7\u0130\u0131\u0301\u201d\u00b2\u03a3\u00a0 \t\n\u0149"), st.characters(codec="utf-8"))), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    coder = token_files.encoder(tokenizer_path())
    ids, at = coder.encode(*raw(pa.array(texts, pa.string())))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == whole(texts)


def test_special_tokens_in_texts():
    texts = ["<|endoftext|>", "x<|endoftext|>,y", "<|ENDOFTEXT|> a", "'<|startoftext|>'s it's IT'S 'll,l"]
    coder = token_files.encoder(tokenizer_path())
    ids, at = coder.encode(*raw(pa.array(texts)))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == whole(texts)
