"""Expressions for comparing, formatting and hashing values.

The functions that checks apply to every column take and return SQL expression
text: a check over many columns is then one parsed expression instead of
thousands of calls into the JVM. Everything is built-in Spark SQL.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.types import DATES, FLOATS, NESTED, TEXTS

EXACT_DOUBLE = 2**53  # integers below this are exact in a double
NULL_TEXT = "nan"

# The characters Python strips as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000")
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NUMBER = rf"^[{_SPACES}]*[+-]?[0-9]+(\.[0-9]*)?[{_SPACES}]*\z"
# A whole number without padding, or a decimal of at most 15 digits without padding (so that
# different texts are different doubles), or text that starts and ends like no number.
_OWN_KEY = (r"^(?:0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]{0,8})\.[0-9]{0,5}[1-9]|"
            rf"[^{_SPACES}0-9+-](?s:.*[^{_SPACES}])?)\z")

# First and last time of bounded dates.
FIRST_TIME, LAST_TIME = "1677-09-21 00:12:44", "2262-04-11 23:47:16"


def name(*path):
    """A column or field reference."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in path)


def text(value):
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def missing(x, dtype):
    """Null, or NaN in a floating-point column."""
    return f"({x} IS NULL OR isnan({x}))" if isinstance(dtype, FLOATS) else f"({x} IS NULL)"


def without_nan(x, dtype):
    return f"if(isnan({x}), NULL, {x})" if isinstance(dtype, FLOATS) else x


def trim_text(x):
    """Strip every kind of Unicode white space from both ends."""
    return f"trim(BOTH {text(WHITE_SPACE)} FROM {x})"


def _number_key(d):
    return (f"CASE WHEN {d} IS NULL OR isnan({d}) THEN NULL "
            f"WHEN abs({d}) < {EXACT_DOUBLE} AND {d} = floor({d}) THEN concat('n:', CAST(CAST({d} AS BIGINT) AS STRING)) "
            f"ELSE concat('n:', CAST({d} AS STRING)) END")


def _text_key(x):
    # One regular expression tells numbers from text; the rest is plain trimming.
    digits = f"trim(TRAILING {text(WHITE_SPACE)} FROM trim(LEADING {text(WHITE_SPACE + '+-0')} FROM {x}))"
    return (f"CASE WHEN {x} IS NULL THEN NULL "
            f"WHEN NOT {x} RLIKE r'{_NUMBER}' THEN concat('s:', {trim_text(x)}) "
            f"WHEN contains({x}, '.') THEN {_number_key(f'try_cast({trim_text(x)} AS DOUBLE)')} "
            f"WHEN {digits} = '' THEN 'n:0' "
            f"WHEN contains({x}, '-') THEN concat('n:-', {digits}) ELSE concat('n:', {digits}) END")


def canon(x, dtype):
    """Type-independent comparison text: numbers `n:`, text `s:`, times `t:`; null for missing."""
    if isinstance(dtype, T.NullType):
        return "CAST(NULL AS STRING)"
    if isinstance(dtype, TEXTS):
        return _text_key(x)
    if isinstance(dtype, T.BinaryType):
        return _text_key(f"CAST({x} AS STRING)")
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {x} THEN 'n:1' WHEN NOT {x} THEN 'n:0' END"
    if isinstance(dtype, T.IntegralType):
        return f"concat('n:', CAST({x} AS STRING))"
    if isinstance(dtype, FLOATS):
        return _number_key(f"CAST({x} AS DOUBLE)")
    if isinstance(dtype, T.DecimalType):
        return (f"CASE WHEN {x} = floor({x}) THEN concat('n:', CAST(CAST({x} AS DECIMAL(38, 0)) AS STRING)) "
                f"ELSE {_number_key(f'CAST({x} AS DOUBLE)')} END")
    if isinstance(dtype, DATES):
        return f"concat('t:', CAST({x} AS STRING))"
    return f"concat('s:', to_json({x}))"


def _is_own_key(x):
    """Text that coercion keeps distinct from every other such text."""
    return f"coalesce({x} RLIKE r'{_OWN_KEY}', FALSE)"


def unequal(s, t, s_type, t_type):
    """True where two cells differ after coercion; never null.

    Cells that are equal as stored never reach the coercion, which is the
    expensive part; two missing values are equal.
    """
    if s_type == t_type and not isinstance(s_type, (*TEXTS, *NESTED, T.BinaryType)):
        return f"(NOT ({without_nan(s, s_type)} <=> {without_nan(t, t_type)}))"
    # The coercion is bulky code. Inside a lambda it stays out of the generated
    # method, which would otherwise grow too long to be compiled for wide tables.
    coerced = (f"exists(array(named_struct('s', {s}, 't', {t})), "
               f"p -> NOT ({canon('p.s', s_type)} <=> {canon('p.t', t_type)}))")
    if isinstance(s_type, TEXTS) and isinstance(t_type, TEXTS):
        return f"(NOT ({s} <=> {t}) AND (({_is_own_key(s)} AND {_is_own_key(t)}) OR {coerced}))"
    return f"(NOT ({s} <=> {t}) AND {coerced})" if s_type == t_type else f"({coerced})"


def atomic(x, dtype):
    """Nested values as JSON text, binary as text, all else as it is."""
    if isinstance(dtype, NESTED):
        return f"to_json({x})"
    return f"CAST({x} AS STRING)" if isinstance(dtype, T.BinaryType) else x


def atomic_frame(df):
    """The frame with every column comparable and orderable; untouched if it already is."""
    if not any(isinstance(f.dataType, (*NESTED, T.BinaryType)) for f in df.schema):
        return df
    return df.selectExpr(*[f"{atomic(name(f.name), f.dataType)} AS {name(f.name)}" for f in df.schema])


def as_text(x, dtype):
    """Text of a cell with missing values spelled out."""
    return f"coalesce(CAST({without_nan(x, dtype)} AS STRING), '{NULL_TEXT}')"


def truncate(x, length=100):
    return f"if(length({x}) > {length}, concat(substring({x}, 1, {length - 3}), '...'), {x})"


def is_quoted(dtype):
    return isinstance(dtype, (*TEXTS, *DATES))


def quoted(x, dtype):
    """Readable form of a value: text and times in quotes, numbers plain."""
    if is_quoted(dtype):
        return f"if({x} IS NULL, '{NULL_TEXT}', concat('''', CAST({x} AS STRING), ''''))"
    return as_text(x, dtype)


def safe_repr(x, dtype, length=100):
    return truncate(quoted(x, dtype), length)


def format_key(columns):
    """`id=123, code='abc'` from [(name, expression, dtype)]."""
    parts = [f"concat({text(n + '=')}, {quoted(x, t)})" for n, x, t in columns]
    return f"concat_ws(', ', {', '.join(parts)})"


def row_hash(columns, algo="md5"):
    """Hash of the `|`-joined text of [(expression, dtype)]."""
    joined = f"CAST(concat_ws('|', {', '.join(as_text(x, t) for x, t in columns) or text('')}) AS BINARY)"
    if algo == "md5":
        return f"md5({joined})"
    if algo == "sha256":
        return f"sha2({joined}, 256)"
    raise ValueError(f"unknown hash '{algo}', expected md5 or sha256")


def is_ascii(x):
    return rf"(NOT {x} RLIKE r'[^\x00-\x7F]')"


def differs_in_case(s, t):
    return f"({s} <> {t} AND lower({s}) = lower({t}))"


def _drop_first_zero(x):
    at = f"locate('0', {x})"
    return f"if({at} > 0, concat(substring({x}, 1, {at} - 1), substring({x}, {at} + 1)), {x})"


def differs_in_leading_zero(s, t):
    """Exactly one side starts with `0`, and dropping the first `0` of both makes them equal."""
    return (f"({s} <> {t} AND startswith({s}, '0') <> startswith({t}, '0') "
            f"AND {_drop_first_zero(s)} = {_drop_first_zero(t)})")


def differs_in_ascii(s, t):
    return f"({s} <> {t} AND {is_ascii(s)} <> {is_ascii(t)})"


def parse_date(x, fmt=None, bounded=False):
    """Timestamp without zone from text; null where it does not parse.

    With `bounded`, also null outside the years that nanoseconds in 64 bits reach.
    """
    parsed = f"CAST(try_to_timestamp({x}{', ' + text(fmt) if fmt else ''}) AS TIMESTAMP_NTZ)"
    if not bounded:
        return parsed
    return (f"CASE WHEN {parsed} BETWEEN TIMESTAMP_NTZ'{FIRST_TIME}' AND TIMESTAMP_NTZ'{LAST_TIME}' "
            f"THEN {parsed} END")


# Single-column functions, on columns.


def slug(c, length=40):
    words = F.regexp_replace(c, r"(?U)[^\w]+", "_")
    return F.substring(F.lower(F.regexp_replace(words, r"^_+|_+$", "")), 1, length)


def allows_part(c, allowed):
    """Some allowed entry occurs in the value, ignoring case; `allowed` is a list or an array column."""
    entries = F.array(*[F.lit(a) for a in allowed]) if isinstance(allowed, (list, tuple)) else allowed
    return F.exists(entries, lambda a: F.contains(F.lower(c), F.lower(a)))


def allows_exact(c, allowed):
    entries = F.array(*[F.lit(a) for a in allowed]) if isinstance(allowed, (list, tuple)) else allowed
    return F.exists(entries, lambda a: F.lower(a) == F.lower(c))


def rgb_to_hex(c):
    """`rgb(255, 0, 10)` -> `#FF000A`; text without three numbers is returned as it is."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)"))
    part = lambda i: F.lpad(F.hex(F.try_element_at(numbers, F.lit(i)).cast("int")), 2, "0")
    return F.when(F.size(numbers) >= 3, F.concat(F.lit("#"), part(1), part(2), part(3))).otherwise(c)


def name_similarity(a, b):
    """1 for equal names, 0 for entirely different ones, ignoring case."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)
