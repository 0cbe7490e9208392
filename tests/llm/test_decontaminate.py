import itertools
import random
import re

from twinframe.llm.decontaminate import MASKS, SHORTEST, SUBSTITUTIONS, WINDOW, contamination


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w, found = words(text), set()
        for item, test in items:
            t = words(test)
            n, spare = (WINDOW, SUBSTITUTIONS) if len(t) >= WINDOW else (len(t), 0)
            if len(t) < SHORTEST:
                continue
            for i in range(len(w) - n + 1):
                for j in range(len(t) - n + 1):
                    if sum(a != b for a, b in zip(w[i:i + n], t[j:j + n])) <= spare:
                        found.add((item, i, j))
        out[d] = (bool(found), len(found), len({f[0] for f in found}), sorted({f[0] for f in found}))
    return out


def test_masks_leave_no_gap():
    for gone in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(all(o + p not in gone for p in m) for m in MASKS for o in range(WINDOW - max(m)))


def test_like_brute_force(spark, frame, prose):
    r = random.Random(4)
    items = [(i, prose(n, 200 + i)) for i, n in enumerate([40, 13, 14, 12, 7, 5, 4, 30])] + [(8, None), (9, ""), (3, prose(12, 203))]
    docs = [(i, prose(80, i)) for i in range(10)]
    for k in range(40):
        test = words(items[k % 8][1])
        part = test[r.randrange(len(test) // 2 + 1):]
        for _ in range(k % 4):
            part[r.randrange(len(part))] = "changed"
        docs.append((10 + k, prose(r.randrange(20), 60 + k) + " " + " ".join(part).upper() + "\n" + prose(r.randrange(20), k)))
    docs += [(60, items[4][1]), (61, None), (62, ""), (63, items[1][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, key int")
    got = {x.doc_id: (x.contaminated, x.n_windows, x.n_items, x["items"]) for x in contamination(frame(docs), bench).collect()}
    want = brute(docs, items)
    assert got == want and sum(w[0] for w in want.values()) > 10


def test_empty_tables_and_odd_rows(spark, frame, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    text = prose(20, 1)
    assert [(x.contaminated, x["items"]) for x in contamination(frame([(1, text), (None, text), (2, None)]), none).collect()] == [(False, [])] * 3
    bench = spark.createDataFrame([(4, text), (None, text)], "item_id long, text string")
    got = contamination(frame([(1, text), (1, text), (None, text)]), bench).collect()
    assert sorted((x.doc_id or 0, x.contaminated) for x in got) == [(0, False), (1, True), (1, True)]
    assert contamination(frame([(1, text)]).where("doc_id > 1"), bench).collect() == []
