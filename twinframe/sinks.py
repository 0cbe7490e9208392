"""Writing results: partitioned Parquet for machines, one CSV file for people."""

import datetime
import re
import uuid

from pyspark.sql import functions as F


def report_folder(name, now=None):
    """A folder name of its own for each report: safe label, time and a random part."""
    label = re.sub(r"[^\w-]+", "_", name.casefold()).strip("_") or "report"
    return f"{label}-{(now or datetime.datetime.now()):%Y-%m-%dT%H%M%S}-{uuid.uuid4().hex[:12]}"


def write_results(results, path, run_id):
    """Append the results of a run to a Parquet table partitioned by run."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


#: Rows of one file of a long report: gzipped files are read whole.
FILE_ROWS = 1_000_000


def write_csv(report, path, single_file=True):
    """A report as CSV with a header. Reports are small; pass single_file=False for long ones, which are gzipped in parts."""
    frame, packed = (report.coalesce(1), {}) if single_file else (report, {"compression": "gzip", "maxRecordsPerFile": FILE_ROWS})
    frame.write.mode("errorifexists").options(header=True, escape='"', emptyValue="", **packed).csv(path)


def write_report(results, output_dir, name, now=None):
    """The result table of one run in a folder of its own, which must not exist; returns the path."""
    path = f"{output_dir.rstrip('/')}/{report_folder(name, now)}"
    write_csv(results, path)
    return path
