"""CSV, delimited text, JSON and Parquet files."""

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.operators.align import lower_columns

# File extensions and the formats they name.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}

CORRUPT = "__whole_row"


def _lines(spark, path):
    """file, at, value of all lines; the least `at` of a file is its first line's."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("at"))


def encodings(spark, path):
    """{encoding: files}: UTF-16 by the byte order mark, else UTF-8 if every line is valid, else ISO-8859-1.

    Reads all lines once; name the encoding to save that. File names reach the
    driver only if there are several encodings.
    """
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    lines = _lines(spark, path).select("file", "at", F.is_valid_utf8("value").alias("valid"), mark.alias("mark"))
    named = F.when(F.col("marked"), "UTF-16").when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")
    files = (lines.groupBy("file").agg(F.min_by("mark", "at").alias("marked"), F.bool_and("valid").alias("valid"))
             .select("file", named.alias("encoding")))
    kinds = [r.encoding for r in files.select("encoding").distinct().collect()]
    if len(kinds) < 2:
        return {kind: [path] for kind in kinds}
    found = {}
    for r in files.orderBy("file").collect():  # one row a file
        found.setdefault(r.encoding, []).append(unquote(r.file))
    return found


def detect_encoding(spark, path):
    """The encoding of a file, or of all files of a folder."""
    found = encodings(spark, path) or {"UTF-8": []}
    if len(found) > 1:
        raise ValueError(f"files of several encodings: {sorted(found)}")
    return next(iter(found))


def read_csv(spark, path, sep=",", encoding=None, multi_line=True):
    """Every column as text; only an empty field is null.

    A row with fewer fields than the header is filled up with nulls, one with
    more is an error, and so is a file whose header is not the folder's. Files
    of a folder may differ in encoding. `multi_line=False` lets Spark split
    large files, for data without line breaks inside quotes.
    """
    groups = {encoding: path} if encoding else encodings(spark, path) or {"UTF-8": path}
    if len(groups) == 1:
        groups = {next(iter(groups)): path}
    frames = [_read_csv(spark, files, sep, name, multi_line) for name, files in groups.items()]
    if any(f.columns != frames[0].columns for f in frames):
        raise ValueError(f"files of one folder have different headers: {[f.columns for f in frames]}")
    return reduce(lambda a, b: a.union(b), frames)


def _read_csv(spark, path, sep, encoding, multi_line):
    if encoding.upper().replace("-", "") == "UTF16":
        multi_line = True
    reader = spark.read.options(
        sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multi_line, header=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT, columnPruning=False)
    found = reader.csv(path).columns
    names = [c.lstrip("\ufeff").strip('"') for c in found]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*found, CORRUPT]])
    rows = reader.option("enforceSchema", False).schema(schema).csv(path).toDF(*names, CORRUPT)
    # Spark marks rows of another length; their fields are counted outside quotes, which open a field only at its start
    bare = F.regexp_replace(CORRUPT, f'(?:^|(?<={re.escape(sep)}))"(?:[^"]|"")*"', "")
    fields = F.size(F.split(bare, re.escape(sep)))
    too_long = F.raise_error(F.lit("a row has more fields than the header")).cast("boolean")
    first = F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0  # Spark refuses to read the marked rows alone
    sound = F.when(F.col(CORRUPT).isNull() | (fields <= len(names)), first).otherwise(too_long)
    return lower_columns(rows.where(sound).drop(CORRUPT))


def _by_lines(spark, path):
    """(files with one JSON object a line, the others); a file whose first line is a whole object and not its last is of the first kind."""
    lines = _lines(spark, path).where("trim(value) <> ''")
    alone = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.from_json("value", "map<string,string>").isNotNull()
    files = (lines.select("file", "at", alone.alias("alone")).groupBy("file")
             .agg((F.min_by("alone", "at") & (F.count("*") > 1)).alias("by_lines")))
    kinds = [r.by_lines for r in files.select("by_lines").distinct().collect()]
    if len(kinds) < 2:
        return ([path], []) if True in kinds else ([], [path])
    found = files.orderBy("file").collect()  # one row a file
    return [[unquote(r.file) for r in found if r.by_lines == wanted] for wanted in (True, False)]


def read_json(spark, path, orient="records", lines=None):
    """JSON documents: 'records', or 'index', 'columns' and 'values' (whose cells become text).

    Records are one document a file or one object a line. Which of them is found
    out by reading all lines once, unless `lines` says it; files with an object
    a line are split over tasks. A line or document that is no JSON is an error.
    """
    if orient == "records":
        read = lambda files, by_lines: lower_columns(spark.read.options(multiLine=not by_lines, mode="FAILFAST").json(files))
        if lines is not None:
            return read(path, lines)
        by_lines, whole = _by_lines(spark, path)
        if not by_lines or not whole:
            return read(path, bool(by_lines))
        return read(by_lines, True).unionByName(read(whole, False), allowMissingColumns=True)
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    if orient == "values":
        rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
        width = rows.agg(F.max(F.size("r"))).first()[0] or 0
        return rows.select(*[F.get("r", F.lit(i)).alias(str(i)) for i in range(width)])
    cells = text.select("file", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("outer", "inner"))
    if orient == "index":
        names = [r[0] for r in cells.select(F.explode(F.map_keys("inner"))).distinct().collect()]
        return lower_columns(cells.select(*[F.col("inner").getItem(n).alias(n) for n in sorted(names)]))
    if orient == "columns":
        names = sorted(r[0] for r in cells.select("outer").distinct().collect())
        long = cells.select("file", "outer", F.explode("inner").alias("row", "value"))
        wide = long.groupBy("file", "row").agg(*[F.max(F.when(F.col("outer") == n, F.col("value"))).alias(n) for n in names])
        return lower_columns(wide.select(*[f"`{n}`" for n in names]))
    raise ValueError(f"unknown JSON orient '{orient}'")


def read_parquet(spark, path):
    return lower_columns(spark.read.parquet(path))


def file_sizes(spark, path):
    """Path and size in bytes of the files below a path; their content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", F.col("length").alias("bytes")))


def read_file(spark, path, format=None, sep=",", encoding=None, json_orient="records", multi_line=True):
    """A file or folder of files in the given format, or the one its extension names."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    format = format or FORMATS.get(extension)
    if format == "csv":
        return read_csv(spark, path, sep, encoding, multi_line)
    if format == "json":
        return read_json(spark, path, json_orient)
    if format == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported format '{format or extension}', expected one of {sorted(set(FORMATS.values()))}")
