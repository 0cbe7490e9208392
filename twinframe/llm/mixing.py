"""Mixing to target weights with soft domain membership.

A word classifier trained on a labelled table predicts how far each document
belongs to each domain. Projected-gradient least squares then finds rates, one
non-negative number a document, whose expected token totals by domain match the
targets. Everything that touches rows is DataFrame work; the driver sees sums
by domain and the classifier's counts.
"""

import numpy as np
from pyspark.sql import functions as F

from twinframe.shared import written

#: Word hash classes of the classifier; with at most MOST_DOMAINS domains the broadcast model stays below 2 MB.
CLASSES, MOST_DOMAINS = 4096, 32
SPACE = r"[\x20\x09-\x0D]+"
#: Rate updates that are kept as an expression before the rates are written.
DEPTH = 8


def word_rows(docs, *columns):
    """The columns and `class`, one row a word (one of class CLASSES where a text has no word)."""
    word = F.explode_outer(F.split(F.lower("text"), SPACE)).alias("word")
    number = F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(CLASSES)).cast("int")).otherwise(CLASSES)
    return docs.select(*columns, word).select(*columns, number.alias("class"))


def fit_classifier(docs, labelled, domains, max_rows):
    """(class, l_0, l_1, ...): log-likelihoods by word class and domain, and the log priors.

    Multinomial naive Bayes on at most `max_rows` labelled documents, picked by hash.
    """
    sample = (labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("domain").alias("domain"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = word_rows(docs.join(F.broadcast(sample), "doc_id"), "doc_id", "domain")
    counts = np.zeros((len(domains), CLASSES + 1))
    for r in rows.groupBy("domain", "class").agg(F.count("*").alias("n")).collect():  # at most domains x classes rows
        counts[domains.index(r["domain"]), r["class"]] = r["n"]
    seen = sample.groupBy("domain").agg(F.count("*").alias("n")).collect()
    prior = np.ones(len(domains))
    for r in seen:
        prior[domains.index(r["domain"])] += r["n"]
    known = counts[:, :CLASSES] + 0.5
    logs = np.zeros((CLASSES + 1, len(domains)))
    logs[:CLASSES] = np.log(known / known.sum(1, keepdims=True)).T
    table = [[i, *map(float, row)] for i, row in enumerate(logs)]
    schema = "class int, " + ", ".join(f"l_{k} double" for k in range(len(domains)))
    return docs.sparkSession.createDataFrame(table, schema), np.log(prior / prior.sum())


def memberships(docs, labelled, domains, max_rows=5000):
    """doc_id, n_tokens, p_0, p_1, ...: words and domain posteriors of each document."""
    if not 1 <= len(domains) <= MOST_DOMAINS:
        raise ValueError(f"1 to {MOST_DOMAINS} domains, not {len(domains)}")
    model, prior = fit_classifier(docs, labelled, domains, max_rows)
    k = range(len(domains))
    sums = (word_rows(docs, "doc_id").join(F.broadcast(model), "class")
            .groupBy("doc_id").agg(F.count_if(F.col("class") < CLASSES).alias("n_tokens"),
                                   *[(F.sum(f"l_{i}") + float(prior[i])).alias(f"s_{i}") for i in k]))
    top = sums.withColumn("top", F.greatest(*[f"s_{i}" for i in k]) if len(domains) > 1 else F.col("s_0"))
    odds = top.select("doc_id", "n_tokens", *[F.exp(F.col(f"s_{i}") - F.col("top")).alias(f"e_{i}") for i in k])
    total = sum((F.col(f"e_{i}") for i in k), F.lit(0.0))
    return odds.select("doc_id", "n_tokens", *[(F.col(f"e_{i}") / total).alias(f"p_{i}") for i in k])


def fit_rates(members, weights, tolerance=1e-6, max_steps=60):
    """members with `rate`, and the relative gap that is left between expected totals and targets.

    Minimises the squared gap, whitened by the domains' Gram matrix, over
    non-negative rates from a start of 1. In that metric, with rows scaled by
    their tokens, the gradient has Lipschitz constant 1, so steps have length 1.
    """
    k = len(weights)
    both = [(i, j) for i in range(k) for j in range(i, k)]
    row = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{i}") * F.col(f"p_{j}")).alias(f"m_{i}_{j}") for i, j in both],
                      F.sum("n_tokens").alias("total")).first()
    total = float(row["total"] or 0)
    rated = members.withColumn("rate", F.lit(1.0))
    if not total:
        return rated, 0.0
    gram = np.zeros((k, k))
    for i, j in both:
        gram[i, j] = gram[j, i] = row[f"m_{i}_{j}"]
    inverse = np.linalg.pinv(gram / total + 1e-12 * np.eye(k))
    target, gap = np.array(weights) / sum(weights) * total, 0.0
    rate = F.col("rate")
    for step in range(max_steps + 1):
        got = rated.agg(*[F.sum(rate * F.col("n_tokens") * F.col(f"p_{i}")).alias(f"a_{i}") for i in range(k)]).first()
        off = (target - np.array(got, float)) / total
        gap = float(np.abs(off).sum())
        if gap < tolerance or step == max_steps:
            break
        move = inverse @ off
        rate = F.greatest(F.lit(0.0), rate + sum((F.col(f"p_{i}") * float(move[i]) for i in range(k)), F.lit(0.0)))
        if step % DEPTH == DEPTH - 1:
            rated, rate = written(rated.withColumn("rate", rate), "rates"), F.col("rate")
    return rated.withColumn("rate", rate), gap


def mix(docs, labelled, weights, max_rows=5000, tolerance=1e-6, max_steps=60):
    """doc_id, n_tokens, domain, posterior, rate, copies, gap of each distinct doc_id.

    `labelled` names the domain of some documents (doc_id, domain); `weights`
    maps the domains to their shares of all tokens. `copies` is the rate rounded
    up or down by a hash of the doc_id, so that it is right on average and the
    same in every run. `gap`, the same in all rows, is how far the expected
    token totals of all domains are from their targets, as a share of all
    tokens: at most `tolerance`, unless no rates or not enough steps meet them.

    Defined results: rows of one doc_id (also of none) are one document with all
    their words; null and empty texts have no tokens and the posterior of the
    labelled rows' shares. Several domains of one labelled document: the first
    in order; domains without a weight are not learnt. A domain without tokens
    cannot reach its target; the others still do as far as they can. Without
    documents the result is empty. Other columns are passed over.
    """
    domains = sorted(weights)
    docs = docs.select("doc_id", "text")
    members = written(memberships(docs, labelled, domains, max_rows), "members")
    rated, gap = fit_rates(members, [weights[d] for d in domains], tolerance, max_steps)
    posterior = F.array(*[f"p_{i}" for i in range(len(domains))])
    names = F.array(*[F.lit(d) for d in domains])
    even = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return (rated.withColumn("posterior", posterior)
            .select("doc_id", "n_tokens", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
                    .alias("domain"), "posterior", "rate",
                    (F.floor("rate") + (even < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"), F.lit(gap).alias("gap")))


def mixed(docs, rates):
    """The rows of documents, each as often as its rate says."""
    key = rates.select(F.col("doc_id").alias("mixed_id"), F.col("copies").alias("mixed_copies"))
    found = docs.join(key.where("mixed_copies > 0"), docs["doc_id"].eqNullSafe(F.col("mixed_id")))
    return (found.withColumn("mixed_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mixed_copies"))))
            .select(*[docs[c] for c in docs.columns]))
