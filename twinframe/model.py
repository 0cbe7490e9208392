"""The result table every check reports into, and its status values."""

from pyspark.sql import types as T


class Status:
    PASS = "PASS"
    FAIL = "FAIL"
    SKIP = "SKIP"
    INFO = "INFO"
    WARN = "WARN"
    ERROR = "ERROR"


RESULT_FIELDS = ["validation", "result", "column", "pk", "detail", "source_value", "target_value"]

RESULT_SCHEMA = T.StructType([T.StructField(f, T.StringType(), False) for f in RESULT_FIELDS])
