"""The operators of this subpackage as registered queries over their whole tables."""

from pyspark.sql import functions as F

from twinframe.llm.decontaminate import contamination
from twinframe.llm.exact_index import exact_dedup
from twinframe.llm.fingerprints import fingerprints
from twinframe.llm.line_dedup import line_dedup
from twinframe.llm.manifest import document_manifest
from twinframe.llm.mixing import mix
from twinframe.llm.near_dedup import near_duplicates
from twinframe.llm.periods import periodic_runs, planted, run_digests
from twinframe.llm.private_data import private_data
from twinframe.llm.substrings import suffix_dedup
from twinframe.llm.token_files import token_index, write_tokens
from twinframe.llm.toxicity import toxicity_scores
from twinframe.llm.warc import archive_index, write_archive

QUERIES, SQL = {}, {}


def query(name, sql=None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op9_toxicity")
def op9_toxicity(spark, sf):
    return toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("votes")


@query("op1_near_duplicates")
def op1_near_duplicates(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query("op10_decontamination")
def op10_decontamination(spark, sf):
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: Shares of all tokens by language and quality label.
WEIGHTS = {f"{lang}/{quality}": share * part
           for lang, share in (("de", 0.2), ("en", 0.4), ("es", 0.2), ("fr", 0.2))
           for quality, part in ((0, 0.1), (1, 0.9))}


def labelled_domains(documents, labels):
    """doc_id, domain (language / quality) of the documents that labels covers."""
    known = labels.where("quality is not null").select("doc_id", "quality")
    return documents.select("doc_id", "lang").join(known, "doc_id").select(
        "doc_id", F.concat_ws("/", "lang", "quality").alias("domain"))


@query("op5_mixing")
def op5_mixing(spark, sf):
    documents = table(spark, sf, "documents")
    return mix(documents, labelled_domains(documents, table(spark, sf, "labels")), WEIGHTS)


def tokenizer_path():
    """The word-level vocabulary of the installed tokenizer files."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_token_files")
def op7_token_files(spark, sf):
    return token_index(spark, write_tokens(table(spark, sf, "documents"), tokenizer_path()))


@query("op6_fingerprints")
def op6_fingerprints(spark, sf):
    return fingerprints(table(spark, sf, "documents"))


@query("op8_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1) for i in range(32)], '')
    AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r""")
def op8_warc(spark, sf):
    return archive_index(spark, write_archive(table(spark, sf, "pages")))


@query("op2_suffix_array")
def op2_suffix_array(spark, sf):
    return suffix_dedup(table(spark, sf, "documents"))


@query("op3_line_dedup")
def op3_line_dedup(spark, sf):
    return line_dedup(table(spark, sf, "documents"))


@query("op4_private_data")
def op4_private_data(spark, sf):
    return private_data(table(spark, sf, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf):
    return run_digests(periodic_runs(planted(table(spark, sf, "documents"))))


def _encoded(*columns):
    """SQL of the columns one after the other, each `-` if null, else its UTF-8 byte count, `:` and its text."""
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


@query("op13_merkle_manifest", sql=f"""
WITH RECURSIVE c AS (
  SELECT *, xor(list_reduce(flatten([[4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in
      string_split(doc_id::VARCHAR, '')])]), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
      ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT) AS crc FROM documents),
e AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM c),
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
  sha256({_encoded("doc_id", "source", "lang", "n_chars", "cut")}) AS tampered FROM e),
p AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (
  SELECT 0 AS level, g, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT level + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, g, pos // 3, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT 0 AS tree, * FROM low UNION ALL SELECT 1, level, '', pos, n, h FROM high),
around AS (
  SELECT a.tree, a.level, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.g = b.g AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT id, g, 0 AS level, pos, tampered AS h, '' AS proof FROM p
  UNION ALL
  SELECT id, c.g, c.level + 1, c.pos // 3, sha256(l || h || r), proof || l || r
  FROM climb c JOIN around x ON x.tree = 0 AND x.g = c.g AND x.level = c.level AND x.pos = c.pos),
half AS (SELECT id, g, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY id, g),
rest AS (
  SELECT id, 0 AS level, s.pos, h, proof FROM half JOIN s USING (g)
  UNION ALL
  SELECT id, c.level + 1, c.pos // 3, sha256(l || h || r), proof || l || r
  FROM rest c JOIN around x ON x.tree = 1 AND x.level = c.level AND x.pos = c.pos),
done AS (SELECT id, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM rest GROUP BY id)
SELECT doc_id, leaf, subroot, h AS root, proof_sha256, folded_root, folded_root = h AS verified
FROM p JOIN s USING (g) JOIN done USING (id) CROSS JOIN (SELECT h FROM high WHERE n = 1)""")
def op13_merkle_manifest(spark, sf):
    return document_manifest(table(spark, sf, "documents"))


@query("op12_exact_dedup", sql=r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, h AS text_sha256
FROM d WINDOW same AS (PARTITION BY h)""")
def op12_exact_dedup(spark, sf):
    return exact_dedup(table(spark, sf, "documents"))
