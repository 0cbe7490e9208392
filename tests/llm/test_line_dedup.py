import random
import time

from pyspark.sql import functions as F

from twinframe.llm import line_dedup as module
from twinframe.llm.line_dedup import SHINGLE, line_dedup, without_lines


def shingles(line):
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def brute(rows):
    """{doc_id: (lines, removed positions)}"""
    own = [(i, p, line.strip(" \t\r").lower()) for i, t in rows if t is not None for p, line in enumerate(t.split("\n"))]
    own = sorted((x for x in own if x[2]), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    sets, up = [shingles(x[2]) for x in own], list(range(len(own)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    out = {i: (0 if t is None else t.count("\n") + 1, []) for i, t in rows}
    for k, (i, p, _) in enumerate(own):
        if root(k) != k:
            out[i][1].append(p)
    return out


def result(df):
    return {r.doc_id: (r.n_lines, r.removed) for r in df.collect()}


def corpus(prose):
    r = random.Random(8)
    pool = [prose(r.randrange(3, 40), i) for i in range(25)] + ["ok", "é", "short", "Ünïcode " * 5, "\U0001f600 smile " * 4]
    rows = []
    for i in range(50):
        found = []
        for k in range(r.randrange(0, 7)):
            line = r.choice(pool) if r.random() < 0.6 else prose(12, 1000 * i + k)
            if r.random() < 0.3 and len(line) > 40:
                at = r.randrange(len(line))
                line = line[:at] + r.choice("xyz") + line[at + 1:]
            found.append(r.choice(["", " ", "\t"]) + (line.upper() if r.random() < 0.2 else line) + r.choice(["", "\r"]))
        rows.append((i, "\n".join(found)))
    return rows + [(90, None), (91, ""), (92, "\n \n"), (93, rows[3][1]), (94, "w" * 30_000 + "\n" + "w" * 29_000)]


def test_like_brute_force(frame, prose):
    rows = corpus(prose)
    docs = frame(rows)
    got = line_dedup(docs)
    want = brute(rows)
    assert result(got) == want and sum(len(w[1]) for w in want.values()) > 40
    texts = {r.doc_id: r.text for r in without_lines(docs, got).collect()}
    for i, t in rows:
        assert texts[i] == (t if not want[i][1] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i][1]))


def test_one_large_family(frame, prose):
    r, line = random.Random(1), prose(30, 5)
    rows = []
    for i in range(60):
        w = list(line)
        for _ in range(1 + i % 5):
            w[r.randrange(len(w))] = r.choice("qvxyz")
        rows.append((i, "".join(w)))
    assert result(module.line_dedup(frame(rows))) == brute(rows)
    # where every bucket is split again, pairs that share one band only are lost
    found = module.duplicate_lines(frame(rows), small=2, few=1).where("not kept").count()
    assert found >= 0.85 * sum(len(w[1]) for w in brute(rows).values())


def test_scratch_tables_are_deleted(frame, prose, tmp_path, monkeypatch):
    rows = corpus(prose)[:40]
    monkeypatch.setattr("twinframe.shared.shared_dir", lambda spark: str(tmp_path))
    got = line_dedup(frame(rows), 75)
    left = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
    assert {"line-places"} <= left <= {"line-places", "links", "hooks"}
    assert result(got) == brute(rows)


def test_odd_tables(frame, prose):
    assert line_dedup(frame([(1, "x")]).where("doc_id > 1")).collect() == []
    line = prose(9, 1)
    got = result(line_dedup(frame([(2, line), (1, line), (1, line), (None, line)])))
    assert got == {None: (1, []), 1: (1, [0]), 2: (1, [0])}


def test_every_large_bucket_is_decided_in_full(frame, prose, monkeypatch):
    r, rows = random.Random(4), []
    for i in range(80):
        line = prose(14, 100 + i // 2)
        rows.append((i, line if i % 2 else line[:-3] + r.choice(("qqq", "vvv"))))
    want = brute(rows)
    signed = module.signed

    def one_bucket(table):
        # all lines share one band, and no two lines another
        made = signed(table)
        return made.withColumn("keys", F.transform("keys", lambda key, b: F.when(b == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("h1", "h2", b))))

    monkeypatch.setattr(module, "signed", one_bucket)
    monkeypatch.setattr("twinframe.llm.buckets.BLOCK", 7, raising=False)
    for few in (1, 256):
        got = module.duplicate_lines(frame(rows), small=2, few=few).where("not kept")
        assert sorted((x.doc_id, x.position) for x in got.collect()) == sorted((i, p) for i, w in want.items() for p in w[1])
    assert sum(len(w[1]) for w in want.values()) == 40


def test_short_lines_at_the_threshold_are_found(frame):
    # 6 shingles in common, 8 in all
    r = random.Random(12)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(15)) for _ in range(2500)]
    rows = [(i, f"{line[:13]}\n{line}") for i, line in enumerate(lines)]
    assert module.duplicate_lines(frame(rows)).where("not kept").count() == len(lines)


def test_long_lines_are_read_once_a_set(frame):
    # a copy of the line for each of its shingles would be 640 GB here
    r = random.Random(3)
    line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400_000))
    wide = frame([(1, line)]).select(F.encode("text", "UTF-32").alias("wide"))
    began = time.time()
    assert wide.select(F.size(module.shingle_set("wide")).alias("n")).head().n == len(shingles(line))
    assert time.time() - began < 40


def compared_pairs(monkeypatch):
    """A list that gets the number of pairs of each full comparison."""
    compared, confirm = [], module.confirm

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(module, "confirm", counted)
    return compared


def test_pairs_within_a_component_are_not_compared_in_full(frame, prose, monkeypatch):
    line = prose(60, 3)
    rows = [(i, line[:9 * i] + "#" + line[9 * i + 1:]) for i in range(30)]
    compared, want = compared_pairs(monkeypatch), brute(rows)
    got = module.duplicate_lines(frame(rows), small=64).where("not kept").collect()
    assert sorted((x.doc_id, x.position) for x in got) == sorted((i, p) for i, w in want.items() for p in w[1])
    assert len(got) == 29 and sum(compared) <= 2 * 29


def test_pairs_that_bitmaps_rule_out_are_not_compared_in_full(frame, monkeypatch):
    # two thirds of each line in common, so 0.5 of the shingles, and all lines in the same buckets
    r = random.Random(6)
    def some(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    start = some(200)
    rows = [(i, start + some(100)) for i in range(40)]
    rows += [(40 + i, text[:-2] + "..") for i, (_, text) in enumerate(rows[:3])]
    want, compared = brute(rows), compared_pairs(monkeypatch)
    got = module.duplicate_lines(frame(rows)).where("not kept").collect()
    assert sorted((x.doc_id, x.position) for x in got) == sorted((i, p) for i, w in want.items() for p in w[1]) == [(40, 0), (41, 0), (42, 0)]
    assert sum(compared) <= 10


def test_bitmaps_rule_out_no_link(frame, prose):
    r, lines = random.Random(9), ["a", "short", "ab" * 900, "abc" * 20, "\U0001f600 smile " * 40, prose(600, 2)]
    for i in range(12):
        line = prose(r.randrange(2, 120), i)
        lines += [line, line[:-1 - len(line) // 30] + "qz", line + line[:len(line) // 4], line[len(line) // 7:]]
    texts = frame(lines).select(F.col("doc_id").alias("id"), F.encode("text", "UTF-32").alias("wide"))
    texts = texts.select("id", "wide", F.size(module.shingle_set("wide")).cast("long").alias("many"))
    assert {x.id: x.many for x in texts.collect()} == {i: len(shingles(line)) for i, line in enumerate(lines)}
    maps = module.bitmaps(texts).localCheckpoint()
    ids = maps.select("id")
    pairs = ids.withColumnRenamed("id", "a").crossJoin(ids.withColumnRenamed("id", "b")).where("a < b")
    left = {(x.a, x.b) for x in module.left_possible(pairs, maps, 75).collect()}
    links = {(a, b) for a in range(len(lines)) for b in range(a) for x, y in [(shingles(lines[a]), shingles(lines[b]))]
             if 100 * len(x & y) >= 75 * len(x | y)}
    links = {(b, a) for a, b in links}
    assert len(links) > 15 and links <= left and len(left) < 2 * len(links)


def test_signatures_follow_the_set_alone(frame):
    # the two lines of a pair have one set, of few shingles
    pairs = [("ab" * 8, "ab" * 900), ("abc" * 20, "bca" * 20 + "b"), ("x" * 8, "x" * 5000), ("0123456789" * 9, "0123456789" * 99)]
    made = {x.line: x for x in module.signed(module.lines(frame([(i, "\n".join(p)) for i, p in enumerate(pairs)]))).join(
        module.lines(frame([(i, "\n".join(p)) for i, p in enumerate(pairs)])), module.NODE).collect()}
    for one, other in pairs:
        assert [made[one][c] for c in (*module.BITS, "keys")] == [made[other][c] for c in (*module.BITS, "keys")]
        assert len(set(made[one]["keys"])) == 2 * module.BANDS and made[one]["bits0"] >= module.FLAG
