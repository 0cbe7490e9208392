import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm.private_data import KINDS, base_spans, private_data, private_spans

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a@b.c", "@", "a.b+c@d-e.f", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-2030",
                                           "+49.123456789", " ", ".", "-", "+", "é", "0", "12", "000000255.1.1.1", "(", "_", "%"]),
                          st.text(alphabet="ab1.@+- ()é", max_size=4)), max_size=14).map("".join))
def test_base_like_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_no_time():
    for text in ("1" * 100_000, "a" * 100_000 + "@", "1.2.3." * 20_000, "1-" * 50_000, "+1" + "(" * 100_000, "@" * 100_000, "a@" * 50_000):
        assert isinstance(base_spans(text), list)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_contexts_find_unseen_identifiers(frame, prose):
    r = random.Random(5)
    texts = []
    for i in range(40):
        number = "+1 (555) 0" + "".join(r.choice("0123456789") for _ in range(6))
        texts.append(f"{prose(20, i)} call me at {number} please {prose(20, 50 + i)}")
    texts += [f"é {prose(10, 200 + i)} call me at (x{i}-7731{i}), please {prose(5, 300 + i)}" for i in range(4)]
    texts += [f"{prose(10, 400)} the 77319999 of {prose(10, 401)}", None, "", "1.2.3.4"]
    rows = {x.doc_id: x for x in private_data(frame(texts)).collect()}
    for i, t in enumerate(texts):
        want, x = brute(t or ""), rows[i]
        assert x.base_sha256 == digest(want)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == j for k, _, _ in want) for j in range(4))
        assert set(digest_parts(want)) - {""} <= set(x.spans.split(","))
    for i in range(4):
        a = texts[40 + i].index(f"x{i}-7731")
        assert rows[40 + i].spans == f"phone:{a}:{a + len(f'x{i}-7731{i}')}"
    assert [rows[44 + i].spans for i in range(4)] == ["", "", "", "ip:0:7"]


def digest_parts(spans):
    return [f"{KINDS[k]}:{a}:{b}" for k, a, b in spans] or [""]


def test_identifiers_without_digits(frame, prose):
    names = [f"{a}.{b}" for a in ("jan", "eva", "tom", "ulf", "mia", "kim", "lea", "ben") for b in ("roe", "poe", "low", "may", "fox")]
    texts = [f"{prose(12, i)} write to {n}@mail.example.org today {prose(9, 300 + i)}" for i, n in enumerate(names)]
    odd = ["jane(at)example(dot)com", "bob@localhost", "(sue_at_home)", "me", "nobody,", "a.b"]
    texts += [f"{prose(7, 600 + i)} write to {o} today {prose(5, 700 + i)}" for i, o in enumerate(odd)]
    texts += [f"{prose(7, 800)} jane(at)example(dot)com {prose(5, 801)}"]
    rows = {x.doc_id: x.spans for x in private_data(frame(texts)).collect()}
    for i, o in enumerate(odd[:3]):
        bare = o.strip("()")
        a = texts[len(names) + i].index(bare)
        assert rows[len(names) + i] == f"email:{a}:{a + len(bare)}"
    assert [rows[len(names) + i] for i in range(3, 7)] == [""] * 4


def test_contexts_that_any_word_fills_find_nothing(frame, prose):
    texts = [f"{prose(8, i)} of the 1.2.3.{i} and so {prose(8, 90 + i)} of the {prose(1, 400 + i)} and" for i in range(60)]
    texts += [f"of the ab{i}123 and so" for i in range(5)]
    assert all(set(x.spans.split(",")) <= set(digest_parts(brute(texts[x.doc_id]))) for x in private_data(frame(texts)).collect())


def test_odd_tables(frame):
    assert private_data(frame([(1, "x")]).where("doc_id > 1")).collect() == []
    got = private_spans(frame([(1, "a@b.c"), (1, "a@b.c"), (1, "other"), (None, "1.2.3.4")])).collect()
    assert sorted((x.doc_id or 0, [tuple(s) for s in x.spans]) for x in got) == [(0, [(1, 0, 7)]), (1, []), (1, [(0, 0, 5)]), (1, [(0, 0, 5)])]


@pytest.mark.parametrize("text", ["4111-1111 1111 1111", "x 4111111111111112 y"])
def test_luhn(text):
    assert base_spans(text) == brute(text)
