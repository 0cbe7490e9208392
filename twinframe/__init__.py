"""twinframe: dataset reconciliation and data-quality checks as Spark DataFrame operators."""

from twinframe.model import RESULT_SCHEMA, Status

__all__ = ["RESULT_SCHEMA", "Status"]
