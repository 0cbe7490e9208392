"""Declarative column rules, compiled into one aggregate over the dataset.

Uniqueness counts distinct values in a second, column-pruned job so that the
other rules need no shuffle.
"""

import datetime
import logging

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.types import DATES, TEXTS, family, is_type
from twinframe.functions.values import as_text, missing, name, without_nan
from twinframe.operators.keys import duplicates, keep_keys
from twinframe.operators.profile import distinct_counts

log = logging.getLogger(__name__)

NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
BETWEEN = "expect_column_values_to_be_between"
REGEX = "expect_column_values_to_match_regex"
IN_SET = "expect_column_values_to_be_in_set"
EXISTS = "expect_column_to_exist"
ROW_COUNT = "expect_table_row_count_to_be_between"
OF_TYPE = "expect_column_values_to_be_of_type"

METRICS_SCHEMA = ("rule int, type string, column string, result string, row_count bigint, violations bigint, "
                  "detail string, target_value string")


class RuleError(ValueError):
    """A rule that cannot be evaluated; reported as ERROR."""


def _require(rule, *names):
    absent = [n for n in names if rule.get(n) in (None, "", [])]
    if absent:
        raise RuleError("Missing " + ", ".join(f"'{n}'" for n in absent) + " parameter")


def _outside(df, rule):
    c, dtype = df[rule["column"]], df.schema[rule["column"]].dataType
    lo, hi = rule.get("min_value"), rule.get("max_value")
    value = F.expr(without_nan(name(rule["column"]), dtype))
    if isinstance(dtype, T.NumericType):
        if any(isinstance(b, str) for b in (lo, hi)):
            raise RuleError(f"bounds of numeric column '{rule['column']}' must be numbers")
        bound = F.lit
    elif isinstance(dtype, DATES):
        bad = [b for b in (lo, hi) if b is not None and _only(df, F.lit(b).try_cast(dtype)) is None]
        if bad:
            raise RuleError(f"no {dtype.simpleString()}: {bad}")
        bound = lambda b: F.lit(b).cast(dtype)
    else:
        raise RuleError(f"column '{rule['column']}' of type {dtype.simpleString()} has no range")
    tests = [value < bound(lo)] if lo is not None else []
    tests += [value > bound(hi)] if hi is not None else []
    return _any(tests)


def _only(df, value):
    """A constant, evaluated; what cannot be is an error of the rule."""
    try:
        return df.sparkSession.range(1).select(value.alias("value")).first()["value"]
    except Exception as e:
        raise RuleError(str(e).splitlines()[0][:200]) from None


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _no_match(df, rule):
    dtype = df.schema[rule["column"]].dataType
    _only(df, F.lit("").rlike(f"^(?:{rule['regex']})"))
    return ~F.expr(as_text(name(rule["column"]), dtype)).rlike(f"^(?:{rule['regex']})")


def _not_in_set(df, rule):
    c, dtype = df[rule["column"]], df.schema[rule["column"]].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        allowed, c = [v for v in rule["value_set"] if isinstance(v, (bool, int, float))], c
        allowed = [float(v) if any(isinstance(x, float) for x in allowed) else int(v) for v in allowed]
        c = c.cast("int") if isinstance(dtype, T.BooleanType) else c
    elif isinstance(dtype, TEXTS):
        allowed = [v for v in rule["value_set"] if isinstance(v, str)]
    else:
        allowed = [v for v in rule["value_set"] if isinstance(v, (datetime.date, datetime.datetime))]
    present = ~_missing(df, rule)
    return present & ~c.isin(allowed) if allowed else present


def _missing(df, rule):
    return F.expr(missing(name(rule["column"]), df.schema[rule["column"]].dataType))


# Row rules: parameters they need, the test for a violating row, and the report texts.
# The texts, which readers of reports look for.
ROW_RULES = {
    NOT_NULL: ((), _missing, "{n} NULL value(s) found", "No NULLs", "NULL_count={n}"),
    BETWEEN: ((), _outside, "{n} value(s) outside [{min_value}, {max_value}]",
              "All values in range [{min_value}, {max_value}]", "min={min_value},max={max_value},violations={n}"),
    REGEX: (("regex",), _no_match, "{n} value(s) not matching pattern", "All values match regex",
            "pattern={regex},violations={n}"),
    IN_SET: (("value_set",), _not_in_set, "{n} value(s) not in allowed set {value_set}",
             "All values in allowed set", "set_size={set_size},violations={n}"),
}


def _fill(template, rule, n):
    """The template as a column, with the rule's parameters and the count put in."""
    values = dict(min_value=rule.get("min_value"), max_value=rule.get("max_value"), regex=rule.get("regex"),
                  value_set=rule.get("value_set"), set_size=len(rule.get("value_set") or []))
    before, _, after = template.partition("{n}")
    text = F.lit(before.format(**values))
    return F.concat(text, n.cast("string"), F.lit(after.format(**values))) if "{n}" in template else text


def _row(i, rule, result, row_count, violations, detail, target_value):
    lit = lambda x: x if not isinstance(x, (str, int, type(None))) else F.lit(x)
    return F.struct(
        F.lit(i).alias("rule"), F.lit(rule["type"]).alias("type"), F.lit(rule.get("column") or "").alias("column"),
        lit(result).alias("result"), lit(row_count).cast("bigint").alias("row_count"),
        lit(violations).cast("bigint").alias("violations"), lit(detail).alias("detail"),
        lit(target_value).alias("target_value"))


def _passed(ok):
    return F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))


def check_expectations(df, expectations):
    """One row per rule: its result, the rows checked, the violations and the report texts.

    Unknown rule types are logged and give no row. A missing column fails, a
    missing parameter or an unsuitable type is an ERROR.
    """
    aggs, rows, unique = [F.count(F.lit(1)).alias("n")], [], []
    n = F.col("n")
    for i, rule in enumerate(expectations or []):
        rule = {**rule, "type": str(rule.get("type", "")).lower()}
        kind, column = rule["type"], rule.get("column")
        known = kind in ROW_RULES or kind in (UNIQUE, EXISTS, ROW_COUNT, OF_TYPE)
        if not known:
            log.warning("unsupported expectation type: %s", kind)
            continue
        try:
            if kind == ROW_COUNT:
                lo, hi = rule.get("min_value") or 0, rule.get("max_value")
                ok = (n >= lo) & (n <= hi if hi is not None else F.lit(True))
                detail = F.concat(F.lit("Row count: "), n.cast("string"), F.lit(f" (bounds [{lo}, {hi}])"))
                target = F.concat(F.lit("rows="), n.cast("string"), F.lit(f",min={lo},max={hi}"))
                rows.append(_row(i, rule, _passed(ok), n, F.when(ok, 0).otherwise(1), detail, target))
                continue
            _require(rule, "column", *(ROW_RULES[kind][0] if kind in ROW_RULES else ()))
            there = column in df.columns
            if kind == EXISTS:
                detail = f"Column '{column}' " + ("exists" if there else "not found")
                rows.append(_row(i, rule, "PASS" if there else "FAIL", n, int(not there), detail, f"exists={there}"))
            elif not there:
                rows.append(_row(i, rule, "FAIL", n, None, f"Column '{column}' does not exist", "FAIL"))
            elif kind == OF_TYPE:
                wanted = str(rule.get("type_name", "object"))
                ok, actual = is_type(df.schema[column].dataType, wanted), family(df.schema[column].dataType)
                rows.append(_row(i, rule, "PASS" if ok else "FAIL", n, int(not ok),
                                 f"Column '{column}' type: {actual} (expected {wanted})",
                                 f"actual={actual},expected={wanted}"))
            elif kind == UNIQUE:
                unique.append(column)
                rows.append(_row(i, rule, None, n, None, None, None))
            else:
                _, test, bad, good, target = ROW_RULES[kind]
                aggs.append(F.count_if(test(df, rule)).alias(f"v{i}"))
                v = F.col(f"v{i}")
                detail = F.concat(F.lit(f"Column '{column}': "),
                                  F.when(v > 0, _fill(bad, rule, v)).otherwise(_fill(good, rule, v)))
                rows.append(_row(i, rule, _passed(v == 0), n, v, detail, _fill(target, rule, v)))
        except RuleError as e:
            rows.append(_row(i, rule, "ERROR", n, None, f"Error: {e}", "ERROR"))
    if not rows:
        return df.sparkSession.createDataFrame([], METRICS_SCHEMA)
    checked = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return _with_uniqueness(df, checked, unique) if unique else checked


def _with_uniqueness(df, checked, columns):
    counted = distinct_counts(df, set(columns))
    joined = checked.join(counted, "column", "left")
    open_rule = F.col("type").eqNullSafe(UNIQUE) & F.col("result").isNull()
    extra = F.col("row_count") - F.col("distinct_count")
    texts = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    column, d, total = F.col("column"), F.col("distinct_count").cast("string"), F.col("row_count").cast("string")
    new = {
        "result": _passed(extra == 0),
        "violations": extra,
        # fixed values: the texts, which readers of reports look for
        "detail": F.when(extra > 0, texts("Column '", column, "': ", extra.cast("string"), " duplicate(s)"))
        .otherwise(texts("Column '", column, "': All ", d, " values unique")),
        "target_value": texts("unique=", d, ",total=", total),
    }
    return joined.select(*[
        (F.when(open_rule, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in checked.columns])


def violating_rows(df, rule):
    """The rows that break a rule; for uniqueness all rows with a repeated or missing value."""
    kind = str(rule.get("type", "")).lower()
    if kind in ROW_RULES:
        _require(rule, "column", *ROW_RULES[kind][0])
        return df.where(ROW_RULES[kind][1](df, rule))
    if kind == UNIQUE:
        column = rule["column"]
        repeated = duplicates(df, [column]).where(F.col(column).isNotNull())
        absent = _missing(df, rule)
        return keep_keys(df.where(~absent), repeated, [column]).unionByName(df.where(absent))
    raise RuleError(f"'{kind}' does not select rows")


def run_expectations(source, target, expectations, run_on="both"):
    """The rules on source, target or both: (side, rule, ...)."""
    sides = [(side, df) for side, df in (("source", source), ("target", target))
             if df is not None and run_on in (side, "both")]
    frames = [check_expectations(df, expectations).withColumn("side", F.lit(side)) for side, df in sides]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
