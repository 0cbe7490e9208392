"""From documents to training files in five stages: filter, deduplicate, decontaminate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with
the columns of documents; the last returns the index of the token files. `run`
writes every stage as Parquet and reads it again, so that a lost executor costs
one stage's work at most.
"""

from pyspark.sql import functions as F

from twinframe.llm.decontaminate import contamination
from twinframe.llm.mixing import mix, mixed
from twinframe.llm.near_dedup import near_duplicates
from twinframe.llm.queries import WEIGHTS, labelled_domains, table, tokenizer_path
from twinframe.llm.token_files import token_index, write_tokens
from twinframe.llm.toxicity import toxicity_scores
from twinframe.shared import new_path, written


def _decided(docs, drops):
    """The rows of docs but those whose doc_id is among drops(docs).

    Rows without an id are decided as well: for that they get ids of their own,
    downwards from the largest number, by their place in the stored rows.
    """
    own = F.lit((1 << 63) - 1) - F.monotonically_increasing_id()
    named = docs.withColumn("pipeline_id", F.coalesce("doc_id", own))
    gone = drops(named.withColumn("doc_id", F.col("pipeline_id")).drop("pipeline_id"))
    # written, so that its size is known: texts are shuffled only if it is too large for a broadcast
    gone = written(gone.select(F.col("doc_id").alias("pipeline_id")).distinct(), "gone")
    return named.join(gone, "pipeline_id", "left_anti").select(*docs.columns)


def toxicity(spark, docs, sf_dir):
    """Documents that score 0.5 or more go."""
    return _decided(docs, lambda rows: toxicity_scores(rows, table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_dedup(spark, docs, sf_dir):
    """Of each group of near-duplicates the document with the smallest doc_id stays, once if its row is repeated."""
    return _decided(docs, lambda rows: near_duplicates(rows).where("not kept")).dropDuplicates()


def decontamination(spark, docs, sf_dir):
    """Documents with a benchmark passage go."""
    return _decided(docs, lambda rows: contamination(rows, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing(spark, docs, sf_dir):
    """Every document as often as its rate says; token totals by language and quality meet the weights."""
    rates = mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), WEIGHTS)
    return mixed(docs, rates)


def token_files(spark, docs, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 of the token files of what is left, read back from them."""
    return token_index(spark, write_tokens(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing),
          ("token_files", token_files)]
#: Learning, MinHash and tokenizing have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages, applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
