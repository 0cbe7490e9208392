"""Toxicity scores by weak supervision.

Lexicon voters (words and word beginnings found in labelled training rows) and
fixed pattern voters vote on every document or abstain. A generative label
model learns from all documents how often each voter is right and how voters
hang together; its posteriors label the training rows of a linear classifier,
which scores every document from its votes.

Defined results: null and empty texts have no words and get the score of a
document nothing votes on but the "no lexicon" voter. Repeated documents are
scored once per row. Several labels of one document: toxic if any is; null
labels are ignored. Without any toxic or any clean training row nothing can be
learnt and every score is 0. Other columns of documents are passed over, so
clashing names do no harm.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinframe.shared import written

WORD = re.compile(r"[^\W\d_]+")
#: Fixed pattern voters. They may know nothing; the label model finds out.
PATTERNS = (
    ("shout", re.compile(r"\b[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}\b")),
    ("bangs", re.compile(r"[!?]{2,}")),
    ("masked", re.compile(r"\b[A-Za-z]+\*+[A-Za-z]*")),
    ("stretched", re.compile(r"([A-Za-z])\1{3,}")),
    ("direct", re.compile(r"\byou (?:are|all|people)\b", re.I)),
)
BEGINNINGS = (4, 5, 6)


def features(text):
    """The distinct words of a text as "=word", and their beginnings as "beginning-"."""
    found = set(WORD.findall(text.lower()))
    out = {"=" + w for w in found}
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in found if len(w) >= n])
    return out


def held_out(column):
    """Rows whose label may not be learnt from."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels, max_rows):
    """doc_id and toxic (0 or 1) of at most `max_rows` training documents, picked by hash."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def induce_voters(rows, max_voters, min_support, min_gain=12.0):
    """Words and beginnings that training labels tie to toxic documents, best first.

    `rows` holds text and toxic. The result has at most `max_voters` names.
    """
    def count(batches):
        seen, size = {}, [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                size[toxic] += 1
                for f in features(text or ""):
                    pair = seen.get(f)
                    if pair is None:
                        seen[f] = pair = [0, 0]
                    pair[toxic] += 1
            if len(seen) > 200_000:
                yield table(seen, [0, 0])
                seen = {}
        yield table(seen, size)

    def table(seen, size):
        names = list(seen) + [""]
        pairs = list(seen.values()) + [size]
        return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()),
                                           "clean": pa.array([p[0] for p in pairs], pa.int64()),
                                           "toxic": pa.array([p[1] for p in pairs], pa.int64())})

    counts = written(rows.select("text", "toxic").mapInArrow(count, "name string, clean long, toxic long")
                     .groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
                     .where(F.col("toxic") + F.when(F.col("name") == "", min_support).otherwise(0) >= min_support),
                     "toxic-features")
    size = counts.where("name = ''").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not size["clean"] or not size["toxic"]:
        return [], 0.0
    prior = size["toxic"] / (size["toxic"] + size["clean"])
    t, c = F.col("toxic"), F.col("clean")
    share = (t + prior) / (t + c + 1)
    # log-likelihood ratio of the feature's own share of toxic rows against the overall one
    gain = t * F.log(share / prior) + c * F.log((1 - share) / (1 - prior))
    best = (counts.where("name <> ''").withColumn("gain", gain).where((F.col("gain") > min_gain) & (share > 0.5))
            .orderBy(F.desc("gain"), "name").limit(max_voters).collect())
    return [r["name"] for r in best], prior


def cast_votes(docs, lexicon):
    """doc_id, votes: the numbers of the voters that speak up, the "no lexicon" voter among them."""
    number = {name: i for i, name in enumerate(lexicon)}
    first = len(lexicon)
    quiet = first + len(PATTERNS)

    def vote(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                votes = sorted(number[f] for f in features(text) & number.keys())
                found = [first + i for i, (_, p) in enumerate(PATTERNS) if p.search(text)]
                out.append(votes + found if votes else found + [quiet])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))],
                                             ["doc_id", "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(vote, f"doc_id {kind}, votes array<int>")


def matrix(lists, width):
    out = np.zeros((len(lists), width))
    for i, votes in enumerate(lists):
        out[i, votes] = 1
    return out


def sums(frame, step, width):
    """Add up numpy rows that `step` makes of each batch: one row for each partition, then one for each place."""
    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                got = step(batch.slice(at, 2000))
                total = got if total is None else total + got
        if total is not None:
            keep = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(total[keep])], ["place", "total"])

    out = np.zeros(width)
    for r in frame.mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out


def label_model(votes, gold, width, prior, rounds=4):
    """How often each voter's documents are toxic, and weights of the voters, from all documents.

    Expectation maximisation: documents get a posterior from the votes, voters
    an accuracy from the posteriors; rows with a training label (`gold`: 0 or 1,
    else null) keep it. Voters that speak up together more often than the class
    explains share their weight: in a document a voter counts 1 / (1 + its
    correlations with the other voters heard there).
    """
    odds = np.log(prior / (1 - prior))
    places = width * width

    def posterior(x, g, accuracy, tie):
        weight = np.log(accuracy / (1 - accuracy)) - odds
        heard = x * weight / (x @ tie + 1)
        p = 1 / (1 + np.exp(-np.clip(odds + heard.sum(1), -30, 30)))
        return np.where(np.isnan(g), p, g)

    def parts(batch):
        x = matrix(batch.column("votes").to_pylist(), width)
        return x, np.array(batch.column("gold").to_pandas(), float)

    def start(batch):
        x, g = parts(batch)
        known = ~np.isnan(g)
        return np.concatenate([x[known].T @ g[known], x[known].sum(0)])

    def pairs(batch):
        x, _ = parts(batch)
        return np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])

    table = votes.select("votes", gold.alias("gold"))
    got = sums(table, start, 2 * width)
    accuracy = (got[:width] + prior) / (got[width:] + 1)
    got = sums(table, pairs, places + width + 1)
    both, alone, n = got[:places].reshape(width, width), got[places:-1], max(got[-1], 1)
    tie = np.zeros((width, width))
    for _ in range(rounds):
        def step(batch, accuracy=accuracy, tie=tie):
            x, g = parts(batch)
            p = posterior(x, g, accuracy, tie)
            return np.concatenate([x.T @ p, [p.sum()]])
        got = sums(table, step, width + 1)
        toxic, mass = got[:width], min(max(got[-1], 1e-9), n)
        accuracy = np.clip((toxic + prior) / (alone + 1), 1e-4, 1 - 1e-4)
        # what two voters would share if only the class tied them together
        a, b = toxic / mass, (alone - toxic) / max(n - mass, 1e-9)
        expected = mass * np.outer(a, a) + (n - mass) * np.outer(b, b)
        spread = np.sqrt(np.outer(alone, alone)) + 1e-9
        tie = np.clip((both - expected) / spread, 0, 1)
        tie[(tie < 0.3) | np.eye(width, dtype=bool)] = 0
    return accuracy, tie, odds, posterior


def fit_linear(x, target, steps=300, ridge=1e-4):
    """Weights and bias of a logistic regression on soft labels."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    rate = 4.0 / max(1.0, x.sum(1).max() if len(x) else 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -30, 30)))
        gap = p - target
        vw = 0.9 * vw - rate * (x.T @ gap / len(x) + ridge * w)
        vb = 0.9 * vb - rate * gap.mean()
        w, b = w + vw, b + vb
    return w, b


def toxicity_scores(docs, labels, max_rows=20_000, max_voters=192, min_support=5, label_error=0.005):
    """doc_id, held_out, score, predicted, votes of every row of documents.

    At most `max_rows` labelled rows (by hash of doc_id) fit the lexicon and the
    classifier and at most `max_voters` lexicon voters are kept; the label model
    is estimated over all documents.
    """
    docs = docs.select("doc_id", "text")
    train = F.broadcast(training_labels(labels, max_rows))  # at most max_rows pairs of numbers
    lexicon, prior = induce_voters(docs.join(train, "doc_id"), max_voters, min_support)
    out = ["doc_id", held_out(F.col("doc_id")).alias("held_out")]
    if not prior:
        return docs.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.array().cast("array<int>").alias("votes"))
    width = len(lexicon) + len(PATTERNS) + 1
    votes = written(cast_votes(docs, lexicon), "toxic-votes")
    marked = votes.join(train, "doc_id", "left")
    accuracy, tie, _, posterior = label_model(marked, F.col("toxic").cast("double"), width, prior)

    sample = marked.where(F.col("toxic").isNotNull()).select("votes", "toxic").limit(max_rows).toPandas()
    x = matrix(list(sample["votes"]), width)
    p = np.clip(posterior(x, np.full(len(x), np.nan), accuracy, tie), 1e-9, 1 - 1e-9)
    # the training label is one more voter, right in all but `label_error` of its rows
    said = np.where(sample["toxic"] == 1, 1, -1) * np.log(1 / label_error - 1)
    w, b = fit_linear(x, 1 / (1 + np.exp(-(np.log(p / (1 - p)) + said))))

    def score(batches):
        for batch in batches:
            got = [b + w[v].sum() for v in batch.column("votes").to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(got, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], ["doc_id", "votes", "score"])

    kind = votes.schema["doc_id"].dataType.simpleString()
    scored = votes.mapInArrow(score, f"doc_id {kind}, votes array<int>, score double")
    return scored.select(*out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")
