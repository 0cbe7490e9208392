"""Content-addressed WARC archive, in DataFrame functions only.

A dataset is a folder of two Parquet tables. `records` holds one row a record:
page_id, the record's exact header text, and the address (SHA-256, length) of
its payload. `payloads` holds the bytes of each address once. Records with
equal payloads are one response and revisits of it. Records come back by
joining both tables; every payload is checked against its address when read.
"""

from pyspark.sql import functions as F

from twinframe.shared import new_path

#: Fixed values of the WARC format and of RFC 4648.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS32, ALPHABET32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: Date of records of which none is known.
DATE = "1970-01-01T00:00:00Z"


def base32(hexadecimal):
    """Bare upper-case base32 of a hexadecimal SHA-1."""
    four = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*four), DIGITS32, ALPHABET32)


def _line(name, value):
    """A header line; left out where the value is null, line breaks in it are escaped."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def write_archive(pages, path=None, min_bytes=0):
    """Archive pages (page_id, url, html); returns the folder.

    Among records with equal payloads of at least `min_bytes` bytes the one with
    the largest page_id is the response and the others refer to it; all smaller
    ones are responses.

    Defined results: a null html is an empty payload; a null url leaves the line
    out. Repeated rows of the largest page_id are all responses. A page without
    an id is a revisit where another page has its payload, else a response. Two
    payloads of one SHA-256 and length but different SHA-1 end the job. Without
    pages both tables are empty. Other columns are passed over.
    """
    path = path or new_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         payload.alias("payload"))
            .withColumn("sha256", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload"))
            .withColumn("n_bytes", F.octet_length("payload").cast("long")))
    address = ["sha256", "n_bytes"]
    same = (F.when(F.min("sha1") == F.max("sha1"), F.max("page_id"))
            .otherwise(F.raise_error(F.lit("two payloads of one SHA-256"))))
    first = rows.groupBy(*address).agg(same.alias("response"))
    typed = rows.drop("payload").join(first, address)
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    name = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    refers = F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(VERSION + END), F.when(revisit, _line("WARC-Type", F.lit("revisit"))).otherwise(_line("WARC-Type", F.lit("response"))),
        _line("WARC-Record-ID", name), _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", refers))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("n_bytes")).cast("string")), F.lit(END))
    typed.select("page_id", header.alias("header"), *address).write.parquet(f"{path}/records")
    rows.groupBy(*address).agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return path


def _payloads(spark, path):
    """Stored payloads; one that is not what its address says ends the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    return stored.withColumn("payload", F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))))


def read_records(spark, path):
    """page_id, record (the bytes of the WARC record), payload (in full, also of revisits)."""
    rows = spark.read.parquet(f"{path}/records").join(_payloads(spark, path), ["sha256", "n_bytes"])
    block = F.when(_field("Content-Length").cast("long") == F.octet_length("payload"), F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit((END * 2).encode())).alias("record"), "payload")


def _field(name):
    found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def archive_index(spark, path):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as headers and stored payloads say.

    A header whose digest is not its payload's ends the job.
    """
    found = _payloads(spark, path).select("sha256", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                          base32(F.sha1("payload")).alias("own_digest"))
    said = F.substring_index(_field("WARC-Payload-Digest"), ":", -1)
    rows = spark.read.parquet(f"{path}/records").join(found, ["sha256", "n_bytes"])
    number = r"^<urn:page:(-?[0-9]+)>$"
    return rows.select(
        F.nullif(F.regexp_extract(F.coalesce(_field("WARC-Record-ID"), F.lit("")), number, 1), F.lit("")).cast("long").alias("page_id"),
        "payload_bytes",
        F.when(said == F.col("own_digest"), said).otherwise(F.raise_error(F.lit("wrong payload digest"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), number, 1), F.lit("")).cast("long").alias("refers_to"))
