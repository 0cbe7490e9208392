"""Tableau workbook archives (.twbx, .tdsx): their data sources, columns, contents and embedded text data.

Every function takes a frame of (path, content), as Spark's binaryFile reader
gives for a folder, and reads the archives in the tasks.
"""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinframe.shared import written

ELEMENT_SCHEMA = ("path string, at int, last int, tag string, attributes map<string,string>, text string, "
                  "files array<string>, file_size bigint")
INVENTORY_SCHEMA = ("path string, workbook_name string, labels array<string>, worksheet_count bigint, dashboard_count bigint, "
                    "file_size bigint, files array<string>")
HIDDEN = ("Parameters", "Sample - Superstore")  # fixed values: built-in sources
UNKNOWN, SYSTEM = "unknown", "System"
MIN_SIMILARITY = 0.5


def read_archives(spark, path):
    """Archives of a folder as (path, content)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.{twbx,tdsx}").load(path).select("path", "content"))


def _archive_rows(archives, rows_of, schema):
    """The rows that `rows_of(path, elements, files, size)` lists of every archive, with the columns of `schema`.

    An element is [at, last, tag, attributes, text]: they are numbered in
    document order, and one holds those from `at` to `last`.
    """
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def read(batches):
        import io
        import zipfile
        from xml.parsers import expat

        import pyarrow as pa

        def flat(text):
            rows, open_ = [], []

            def start(tag, attributes):
                open_.append(len(rows))
                rows.append([len(rows), 0, tag, attributes, ""])

            def end(_):
                rows[open_.pop()][1] = len(rows) - 1

            def characters(data):
                rows[open_[-1]][4] += data

            parser = expat.ParserCreate()
            parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
            parser.Parse(text, True)
            return rows

        for batch in batches:
            out = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    files = archive.namelist()
                    described = [f for f in files if f.endswith((".twb", ".tds"))]
                    if not described:
                        raise ValueError(f"{path}: no .twb or .tds file in the archive")
                    elements = flat(archive.read(described[0]))
                out += rows_of(path, elements, files, len(content))
            columns = zip(*out) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

    return archives.mapInArrow(read, schema)


def xml_elements(archives):
    """The elements of each archive's description, numbered in document order.

    An element holds those from `at` to `last`. The first element of an archive
    also has the names of its files and its size.
    """
    def every(path, elements, files, size):
        return [(path, at, last, tag, list(attributes.items()), text, None if at else files, size)
                for at, last, tag, attributes, text in elements]

    return _archive_rows(archives, every, ELEMENT_SCHEMA)


def _sources(elements):
    """path, label, first, last: the data sources shown, of equal labels the last one."""
    attribute = F.col("attributes").getItem
    shown = elements.where((F.col("tag") == "datasource") & ~F.coalesce(attribute("name"), F.lit("")).isin(*HIDDEN))
    number = F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1
    label = F.coalesce(attribute("caption"), attribute("name"), F.concat(F.lit("Datasource_"), number.cast("string")))
    return (shown.select("path", label.alias("label"), "at", "last").groupBy("path", "label")
            .agg(F.max(F.struct("at", "last")).alias("x")).select("path", "label", F.col("x.at").alias("first"), "x.last"))


def _mentions(elements):
    """path, at, raw, datatype, found_by, level: columns that an element names, the surest kind of element first."""
    attribute = F.col("attributes").getItem
    records = elements.where("tag = 'metadata-record'").select("path", F.col("at").alias("record"), F.col("last").alias("end"))
    parts = elements.where("tag in ('local-name', 'local-type')").select("path", "at", "tag", "text")
    text = lambda tag: F.min_by("text", F.when(F.col("tag") == tag, F.col("at"))).alias(tag)
    one = (parts.join(records, "path").where("at > record and at <= end").groupBy("path", "record")
           .agg(text("local-name"), text("local-type"), F.bool_or(F.col("tag") == "local-name").alias("named")).where("named")
           .select("path", F.col("record").alias("at"), F.col("local-name").alias("raw"), F.nullif("local-type", F.lit("")).alias("datatype"),
                   F.lit("metadata-record").alias("found_by"), F.lit(1).alias("level")))
    two = elements.where("tag = 'column'").select(
        "path", "at", F.coalesce(attribute("name"), attribute("caption")), attribute("datatype"), F.lit("column-element"), F.lit(2))
    three = elements.where(F.startswith(attribute("name"), F.lit("["))).select(
        "path", "at", attribute("name"), F.coalesce(attribute("datatype"), attribute("type")), F.lit("element-search"), F.lit(3))
    return one.union(two).union(three).withColumn("datatype", F.coalesce("datatype", F.lit(UNKNOWN)))


def workbook_catalog(archives):
    """One row per data source column of every archive.

    A source's columns come from its metadata records, else its column elements,
    else all elements with a bracketed name. Of equal names the last record or
    column counts, or the first other element.

    The elements that count are written once: archives are opened and parsed a
    single time, whatever the number of joins.
    """
    useful = F.col("tag").isin("datasource", "metadata-record", "local-name", "local-type", "column")
    bracketed = F.startswith(F.col("attributes").getItem("name"), F.lit("["))
    elements = written(xml_elements(archives).where(useful | bracketed).select("path", "at", "last", "tag", "attributes", "text"), "elements")
    name = F.btrim("raw", F.lit("[]"))
    listed = (_mentions(elements).withColumn("column_name", name)
              .where((F.col("column_name") != "") & ~F.startswith("column_name", F.lit(SYSTEM)))
              .join(_sources(elements).withColumnRenamed("last", "end"), "path").where("at > first and at <= end"))
    best = listed.withColumn("best", F.min("level").over(Window.partitionBy("path", "label"))).where("level = best")
    chosen = F.max_by(F.struct("datatype", "raw", "found_by"), F.when(F.col("level") < 3, F.col("at")).otherwise(-F.col("at")))
    unique = best.groupBy("path", "label", "column_name").agg(chosen.alias("x"), F.min("at").alias("at"))
    position = F.row_number().over(Window.partitionBy("path", "label").orderBy("at")) - 1
    return unique.select("path", F.col("label").alias("datasource_name"), "column_name", "x.datatype", F.col("x.raw").alias("raw_name"),
                         "x.found_by", position.alias("position"))


def workbook_inventory(archives):
    """Counts, size and embedded data kinds of every archive.

    Counted where the archive is read, so one row an archive is grouped, not one
    an element. Archives of one path add up.
    """
    hidden = HIDDEN

    def counted(path, elements, files, size):
        labels, kinds = [], {"worksheet": 0, "dashboard": 0}
        for at, _, tag, attributes, _ in elements:
            if tag in kinds:
                kinds[tag] += 1
            elif tag == "datasource" and attributes.get("name") not in hidden:
                labels.append(attributes.get("caption", attributes.get("name", f"Datasource_{at}")))
        return [(path, elements[0][3].get("name", "Unknown"), labels, *kinds.values(), size, files)]

    listed = _archive_rows(archives, counted, INVENTORY_SCHEMA)
    total = lambda c: F.sum(c).cast("int").alias(c)
    counts = listed.groupBy("path").agg(
        F.min("workbook_name").alias("workbook_name"),
        F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("datasource_count"),
        total("worksheet_count"), total("dashboard_count"), F.max("file_size").alias("file_size"), F.min("files").alias("files"))

    def has(*ends):
        return F.exists("files", lambda f: f.rlike("(?:" + "|".join(ends) + ")$"))

    return counts.select("path", "workbook_name", "datasource_count", "worksheet_count", "dashboard_count", "file_size",
                         has(r"\.hyper").alias("has_hyper"), has(r"\.tde").alias("has_tde"),
                         has(r"\.csv", r"\.tsv", r"\.txt").alias("has_csv"))


def embedded_rows(archives):
    """Rows of the first embedded text file of every archive: (path, row, cells as a name -> text map).

    Fields are split at commas, or at tabs if the commas do not fit.
    """
    def read(batches):
        import csv
        import io
        import zipfile

        def parse(text, sep):
            lines = list(csv.reader(io.StringIO(text), delimiter=sep))
            return lines if all(len(line) <= len(lines[0]) for line in lines) else None

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                archive = zipfile.ZipFile(io.BytesIO(content))
                inner = [n for n in archive.namelist() if n.endswith((".csv", ".tsv", ".txt"))]
                if not inner:
                    continue
                text = archive.read(inner[0]).decode("utf-8-sig")
                lines = parse(text, ",") or parse(text, "\t") or []
                header = [h.lower() for h in lines[0]] if lines else []
                for i, line in enumerate(line for line in lines[1:] if line):
                    rows.append((path, i, {h: v or None for h, v in zip(header, line)}))
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return archives.mapInPandas(read, "path string, row int, cells map<string,string>")


def embedded_frame(archives, columns):
    """The embedded rows with the named columns."""
    return embedded_rows(archives).select("path", "row", *[F.col("cells").getItem(c).alias(c) for c in columns])


def match_source(catalog, name):
    """Best matching data source name of every archive, if more than half alike."""
    from twinframe.functions.values import name_similarity
    ranked = catalog.select("path", "datasource_name").distinct().withColumn(
        "similarity", name_similarity(F.col("datasource_name"), F.lit(name)))
    best = F.max(F.struct("similarity", "datasource_name")).alias("b")
    return (ranked.groupBy("path").agg(best).where(F.col("b.similarity") > MIN_SIMILARITY)
            .select("path", F.col("b.datasource_name").alias("datasource_name"), F.col("b.similarity").alias("similarity")))
