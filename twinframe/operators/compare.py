"""Cell-by-cell comparison of two datasets, by key or by sorted position."""

import itertools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.types import FLOATS, TEXTS
from twinframe.functions.values import (
    NULL_TEXT, as_text, atomic_frame, differs_in_ascii, differs_in_case, differs_in_leading_zero, is_quoted, name,
    row_hash, text, truncate, unequal)
from twinframe.operators.keys import first_n
from twinframe.shared import written


def _cells(pair, column):
    return name("s", column), name("t", column)


def _differs(pair, column):
    s, t = _cells(pair, column)
    return unequal(s, t, pair.s_type(column), pair.t_type(column))


def _struct(**fields):
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + ")"


def _array(items):
    return f"array({', '.join(items)})"


def mismatch_counts(pair, columns=None):
    """(column, compared, mismatches) for every common column, one aggregate over one join."""
    columns = columns or pair.columns
    counted = pair.matched().selectExpr(
        "count(1) AS compared", *[f"count_if({_differs(pair, c)}) AS m{i}" for i, c in enumerate(columns)])
    rows = [_struct(column=text(c), compared="compared", mismatches=f"m{i}") for i, c in enumerate(columns)]
    return counted.selectExpr(f"inline({_array(rows)})")


def _raw(x, length=101):
    """Start of a cell as text: enough to show, however long the cell is."""
    return f"substring(CAST({x} AS STRING), 1, {length})"


def _shown(pair, value, side):
    """A raw cell of column `column` as shown: text and times in quotes, null as `nan`, 100 characters at most."""
    schema = pair.s_schema if side == "s" else pair.t_schema
    in_quotes = [text(c) for c in pair.columns if is_quoted(schema[c].dataType)]
    marked = f"if(`column` IN ({', '.join(in_quotes)}), concat('''', {value}, ''''), {value})" if in_quotes else value
    return truncate(f"coalesce({marked}, '{NULL_TEXT}')")


def mismatches(pair, columns=None):
    """Every unequal cell: key columns, `pk`, column, source_value, target_value."""
    def cell(c):
        s, t = _cells(pair, c)
        found = _struct(column=text(c), source_value=_raw(s), target_value=_raw(t))
        return f"CASE WHEN {_differs(pair, c)} THEN {found} END"
    cells = [cell(c) for c in columns or pair.columns]
    found = pair.matched().selectExpr(
        *pair.key_names, f"{pair.key_text()} AS pk", f"inline(array_compact({_array(cells)}))")
    return found.selectExpr(
        *pair.key_names, "pk", "`column`", *[f"{_shown(pair, v, v[0])} AS {v}" for v in ("source_value", "target_value")])


def mismatch_examples(pair, n=3, columns=None):
    """The first n unequal cells of each column by key."""
    found = first_n(mismatches(pair, columns), pair.key_names, n, "column")
    return found.select("column", F.col("__rank").alias("example"), "pk", "source_value", "target_value")


# Text fidelity. Each rule says for one pair of cells whether it is a hit.
TEXT_RULES = {
    "case_sensitivity_check": differs_in_case,
    "leading_zero_check": differs_in_leading_zero,
    "special_char_check": differs_in_ascii,
}


TEXT_CHECK_SCHEMA = "validation string, column string, hits bigint, pk string, source_value string, target_value string"


def _rule_columns(pair, rule):
    need = any if rule == "leading_zero_check" else all
    return [c for c in pair.columns if need(isinstance(t, TEXTS) for t in (pair.s_type(c), pair.t_type(c)))]


def text_check(pair, rules=tuple(TEXT_RULES), sample_rows=None):
    """Hits per (validation, column) and the first one by key.

    All matched rows are looked at; `sample_rows` limits that to the first
    rows by key.
    """
    checks = [(r, c) for r in rules for c in _rule_columns(pair, r)]
    aggs, out = [], []
    for i, (rule, c) in enumerate(checks):
        s, t = (f"CAST({x} AS STRING)" for x in _cells(pair, c))
        hit = TEXT_RULES[rule](s, t)
        first = f"struct(struct({', '.join(pair.key_names)}) AS o, pk, {s} AS sv, {t} AS tv)"
        aggs += [f"count_if({hit}) AS n{i}", f"min(CASE WHEN {hit} THEN {first} END) AS e{i}"]
        out.append(_struct(validation=text(rule), column=text(c), hits=f"n{i}", pk=f"e{i}.pk",
                           source_value=f"e{i}.sv", target_value=f"e{i}.tv"))
    rows = pair.matched().selectExpr("*", f"{pair.key_text()} AS pk")
    if sample_rows:
        rows = rows.orderBy(*pair.key_names).limit(sample_rows)
    if not checks:
        return rows.sparkSession.createDataFrame([], TEXT_CHECK_SCHEMA)
    return rows.selectExpr(*aggs).selectExpr(f"inline({_array(out)})")


def row_hashes(pair, algo="md5", parity=False):
    """Key, `pk`, source_hash and target_hash of every matched row.

    The hash covers the common non-key columns by name. With `parity` each
    side hashes all its non-key columns in its own order, so an extra or moved
    column shows as a difference.
    """
    def side(p, schema):
        names = schema.names if parity else pair.columns
        return row_hash([(name(p, c), schema[c].dataType) for c in names if c not in pair.keys], algo)
    return pair.matched().selectExpr(
        *pair.key_names, f"{pair.key_text()} AS pk", f"{side('s', pair.s_schema)} AS source_hash",
        f"{side('t', pair.t_schema)} AS target_hash")


def checksum_counts(hashes):
    return hashes.agg(F.count(F.lit(1)).alias("compared"),
                      F.count_if(F.col("source_hash") != F.col("target_hash")).alias("mismatches"))


def checksum_examples(hashes, pair, n=5):
    differing = hashes.where("source_hash <> target_hash")
    return first_n(differing, pair.key_names, n).select(
        "pk", F.substring("source_hash", 1, 16).alias("source_hash"),
        F.substring("target_hash", 1, 16).alias("target_hash"))


# All key-based findings of a pair in one narrow frame.

EXAMPLES = {"source_dup": 5, "target_dup": 5, "source_only": 5, "target_only": 5, "value": 3, "checksum": 5}


def findings(pair, text_rules=(), checksum=False, algo="md5", carried=()):
    """One row per key with `both` and the array `found` of (kind, column, source_value, target_value).

    `found` is empty for keys without a finding, so the frame is narrow; the
    key is spelled out in `pk` only where something was found. `carried` are
    further columns of the pair, as SQL.
    """
    both = "(s IS NOT NULL AND t IS NOT NULL)"

    def entry(kind, test, column="", sv="''", tv="''"):
        found = _struct(kind=text(kind), column=text(column), source_value=sv, target_value=tv)
        return f"CASE WHEN {test} THEN {found} END"

    entries = [
        entry("source_dup", "s_n > 1", sv="CAST(s_n AS STRING)"),
        entry("target_dup", "t_n > 1", tv="CAST(t_n AS STRING)"),
        entry("source_only", "s IS NOT NULL AND t IS NULL", sv="'EXISTS'", tv="'MISSING'"),
        entry("target_only", "t IS NOT NULL AND s IS NULL", sv="'MISSING'", tv="'EXISTS'"),
    ]
    for c in pair.columns:
        s, t = _cells(pair, c)
        entries.append(entry("value", f"{both} AND {_differs(pair, c)}", c, _raw(s), _raw(t)))
    for rule in text_rules:
        for c in _rule_columns(pair, rule):
            s, t = (f"CAST({x} AS STRING)" for x in _cells(pair, c))
            entries.append(entry(rule, f"{both} AND {TEXT_RULES[rule](s, t)}", c, _raw(s), _raw(t)))
    if checksum:
        s_hash, t_hash = (
            row_hash([(name(p, c), schema[c].dataType) for c in pair.columns if c not in pair.keys], algo)
            for p, schema in (("s", pair.s_schema), ("t", pair.t_schema)))
        # Rows whose cells read the same need no hash.
        differ = []
        for c in pair.columns:
            s, t = _cells(pair, c)
            typed = pair.s_type(c) == pair.t_type(c) and not isinstance(pair.s_type(c), FLOATS)
            differ.append(f"NOT ({s} <=> {t})" if typed else f"NOT (CAST({s} AS STRING) <=> CAST({t} AS STRING))")
        test = f"{both} AND ({' OR '.join(differ)}) AND {s_hash} <> {t_hash}"
        entries.append(entry("checksum", test, "", f"substring({s_hash}, 1, 16)", f"substring({t_hash}, 1, 16)"))
    rows = pair.frame.selectExpr(*pair.key_names, f"{both} AS `both`", f"{pair.key_text()} AS pk",
                                 f"array_compact({_array(entries)}) AS found", *carried)
    return rows.withColumn("pk", F.expr("if(size(found) > 0, pk, NULL)"))


def finding_counts(found):
    """(kind, column, n, rows): findings per kind and column, and the rows behind duplicate keys."""
    cells = found.select(F.inline("found"))
    size = F.coalesce(F.col("source_value").try_cast("bigint"), F.lit(0)) + F.coalesce(
        F.col("target_value").try_cast("bigint"), F.lit(0))
    return cells.groupBy("kind", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("kind").isin("source_dup", "target_dup"), size)).alias("rows"))


def finding_examples(found, pair):
    """The first findings by key of every kind and column."""
    cells = found.select(*pair.key_names, "pk", F.inline("found"))
    ranked = first_n(cells, pair.key_names, max(EXAMPLES.values()), ["kind", "column"])
    cap = F.lit(1)
    for kind, n in EXAMPLES.items():
        cap = F.when(F.col("kind") == kind, F.lit(n)).otherwise(cap)
    shown = lambda v: F.expr(f"if(kind = 'value', {_shown(pair, v, v[0])}, {v})")
    return ranked.where(F.col("__rank") <= cap).select(
        "kind", "column", F.col("__rank").alias("example"), "pk",
        *[shown(v).alias(v) for v in ("source_value", "target_value")])


# Comparison without a key: row i of the sorted source against row i of the sorted target.

TIE = "__tie"

def _placed(df, columns):
    """Every row as text with its place in the text sort of all columns (position, columns), and the row total.

    One range sort: a row number breaks ties, so equal rows spread over parts as
    well, and the numbers given behind the sort hold part and place.
    """
    texts = df.selectExpr(*[f"{as_text(name(c), df.schema[c].dataType)} AS {name(c)}" for c in columns])
    ordered = (texts.withColumn(TIE, F.monotonically_increasing_id()).orderBy(*[F.col(name(c)) for c in columns], TIE).drop(TIE)
               .withColumn("__at", F.monotonically_increasing_id()))
    # Written once: positions rely on one fixed split into sorted parts.
    parts = written(ordered, "sorted", compression="zstd").withColumn("__part", F.shiftright("__at", 33))
    sizes = sorted(parts.groupBy("__part").count().collect())  # one row per sorted part
    ends = list(itertools.accumulate(size for _, size in sizes))
    offsets = df.sparkSession.createDataFrame(
        [(part, end - size) for (part, size), end in zip(sizes, ends)], "__part bigint, __offset bigint")
    place = F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (parts.join(F.broadcast(offsets), "__part")  # as many rows as sorted parts
            .select(place.alias("position"), *[F.col(name(c)) for c in columns])), (ends[-1] if ends else 0)


def sorted_positions(df, columns):
    """Every row as text with its position in the text sort of all columns."""
    return _placed(df, columns)[0]


def positional_segments(source, target, columns=None):
    """The rows of both sides at each position, as (position, length, s, t); `s` and `t` are the rows as text.

    Positions beyond the shorter side are ignored. Positions are unique, so
    their join has no heavy key. `length` is 1.
    """
    source, target = atomic_frame(source), atomic_frame(target)
    columns = columns or sorted(set(source.columns) & set(target.columns))
    sides = []
    for df, side in ((source, "s"), (target, "t")):
        rows, _ = _placed(df, columns)
        sides.append(rows.select("position", F.struct(*[F.col(name(c)) for c in columns]).alias(side)))
    return sides[0].join(sides[1], "position").select("position", F.lit(1).cast("bigint").alias("length"), "s", "t")


def _text_differs(column):
    return unequal(name("s", column), name("t", column), T.StringType(), T.StringType())


def positional_mismatch_counts(segments):
    """(column, compared, mismatches) per column."""
    columns = segments.schema["s"].dataType.names
    counted = segments.selectExpr(
        "coalesce(sum(length), 0) AS compared",
        *[f"coalesce(sum(if({_text_differs(c)}, length, 0)), 0) AS m{i}" for i, c in enumerate(columns)])
    rows = [_struct(column=text(c), compared="compared", mismatches=f"m{i}") for i, c in enumerate(columns)]
    return counted.selectExpr(f"inline({_array(rows)})")


def positional_mismatch_examples(segments, n=100):
    """The first n unequal cells by (position, column)."""
    def cell(c):
        shown = lambda x: f"substring(concat('''', {x}, ''''), 1, 100)"
        found = _struct(column=text(c), source_value=shown(name("s", c)), target_value=shown(name("t", c)))
        return f"CASE WHEN {_text_differs(c)} THEN {found} END"
    columns = segments.schema["s"].dataType.names
    cells = F.expr(f"array_compact({_array([cell(c) for c in columns])})")
    hits = segments.select("position", "length", F.inline(cells))
    # A stretch can supply n examples at most, so only its first n positions are listed.
    last = F.col("position") + F.least(F.col("length"), F.lit(n)) - 1
    return (
        hits.select(F.explode(F.sequence("position", last)).alias("position"), "column", "source_value", "target_value")
        .orderBy("position", "column").limit(n))
