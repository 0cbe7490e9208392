"""The whole result table of a validation run as SQL, put together check by check."""

TIME, TEXT = ("timestamp_ntz", "timestamp", "date"), "string"


class RunSql:
    """Two relations with a key, compared as a run does.

    `types` names the common columns' types in the source's order, `tests` says
    when two cells (of s and t) differ. `cut` is true if the target has more rows
    and is cut to the source's keys. `more` are columns only the source has.
    """

    def __init__(self, source, target, keys, types, tests, regression=False, cut=False, more=(), rules=()):
        self.keys, self.types, self.tests, self.regression, self.cut = keys, types, tests, regression, cut
        self.columns, self.more, self.rules = sorted(types), sorted(more), rules
        listed, key = ", ".join(types), ", ".join(keys)
        order = ", ".join(f"{c} NULLS FIRST" for c in types)
        one = lambda side: (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn, "
                            f"count(*) OVER (PARTITION BY {key}) AS n FROM {side}) AS ranked WHERE rn = 1")
        kept = f" WHERE ({key}) IN (SELECT ({key}) FROM s_all)" if cut else ""
        self.ctes = [f"s_all AS (SELECT {listed} FROM ({source}) AS x)", f"t_all AS (SELECT {listed} FROM ({target}) AS x{kept})",
                     f"s_one AS ({one('s_all')})", f"t_one AS ({one('t_all')})"]
        for this, other in ("st", "ts"):
            self.ctes.append(f"{this}_only AS (SELECT x.* FROM {this}_one x WHERE ({key}) NOT IN (SELECT ({key}) FROM {other}_one))")
        self.ctes.append(f"m AS (SELECT (SELECT count(*) FROM {self.joined()}) AS common, (SELECT count(*) FROM s_only) AS s_only, "
                         "(SELECT count(*) FROM t_only) AS t_only)")

    def joined(self):
        return f"s_one s JOIN t_one t USING ({', '.join(self.keys)})"

    def pk(self, p=""):
        """The key as shown."""
        shown = [f"'{', ' if i else ''}{k}=', {self.shown(k, p)}" for i, k in enumerate(self.keys)]
        return f"concat({', '.join(shown)})"

    def text(self, c, p=""):
        return f"strftime({p}{c}, '%Y-%m-%d %H:%M:%S')" if self.types[c] in TIME else f"CAST({p}{c} AS VARCHAR)"

    def shown(self, c, p=""):
        plain = self.text(c, p)
        if self.types[c] == TEXT or self.types[c] in TIME:
            return f"CASE WHEN {p}{c} IS NULL THEN 'nan' ELSE concat('''', {plain}, '''') END"
        return f"coalesce({plain}, 'nan')"

    def row(self, check, result, detail, column="''", pk="''", s="''", t="''", rest=""):
        return (f"SELECT '{check}' AS validation, {result} AS result, {column} AS \"column\", {pk} AS pk, {detail} AS detail, "
                f"CAST({s} AS VARCHAR) AS source_value, CAST({t} AS VARCHAR) AS target_value {rest}")

    def first(self, n, check, result, detail, rest, p="", **values):
        """Rows for the first n by key of what `rest` selects from."""
        inner = self.row(check, result, detail, pk=self.pk(p), rest=rest, **values)
        return f"SELECT * FROM ({inner} ORDER BY {', '.join(p + k for k in self.keys)} LIMIT {n}) AS first_rows"

    def passed(self, check, text, found, s="''", t="''", also="TRUE"):
        """The row of a check that none of the selections `found` has anything for."""
        none = " AND ".join(f"NOT EXISTS ({f})" for f in found) or "TRUE"
        return self.row(check, "'PASS'", text, s=s, t=t, rest=f"FROM m WHERE {none} AND {also}")

    def parts(self):
        verdict = lambda test: f"CASE WHEN {test} THEN 'PASS' ELSE 'FAIL' END"
        note = " (cut to matching keys)" if self.cut else ""
        counts = lambda agg: f"(SELECT {agg} AS a FROM s_all) AS s, (SELECT {agg} AS a FROM t_all) AS t"
        yield self.row("record_count_check", verdict("s.a = t.a"), f"concat('Source: ', s.a, ' rows, Target: ', t.a, ' rows{note}')",
                       s="s.a", t="t.a", rest=f"FROM {counts('count(*)')}")
        n, common = len(self.types) + len(self.more), len(self.types)
        only = f" | Source-only: [{', '.join(repr(c) for c in self.more)}]".replace("'", "''") if self.more else ""
        yield self.row("column_count_check", "'PASS'", f"'Source: {n} columns, Target: {common} columns, Common: {common}{only}'",
                       s=f"'{n}'", t=f"'{common}'")
        for c in self.columns:
            kind = self.types[c]
            yield self.row("metadata_type_check", "'PASS'", f"'Compatible types: Source ''{kind}'', Target ''{kind}'''", f"'{c}'",
                           s=f"'{kind}'", t=f"'{kind}'")
        for p, side in (("s", "Source"), ("t", "Target")):
            many = f"FROM {p}_one WHERE n > 1"
            yield self.first(5, "duplicate_check", "'FAIL'", f"concat('{side} has ', n, ' rows with this key (first 5 of ', "
                             f"(SELECT sum(n) {many}), ' duplicate rows)')", many, **{p: "n"})
            yield self.passed("duplicate_check", f"'No duplicates found in {side}'", [f"SELECT 1 {many}"], **{p: "'0'"})
        nulls = [(c, f"FROM {counts(f'count(*) - count({c})')} WHERE s.a > 0 OR t.a > 0") for c in self.columns]
        for c, rest in nulls:
            yield self.row("null_check", verdict("s.a = t.a"), "concat('Source: ', s.a, ' nulls, Target: ', t.a, ' nulls')", f"'{c}'",
                           s="s.a", t="t.a", rest=rest)
        yield self.passed("null_check", "'No null values found in any common columns'", [f"SELECT 1 {r}" for _, r in nulls], "'0'", "'0'")
        texts = [c for c in self.columns if self.types[c] == TEXT]
        empty = [(p, side, c, f"FROM {p}_all WHERE {c} = ''") for p, side in (("s", "Source"), ("t", "Target")) for c in texts]
        for p, side, c, rest in empty:
            yield self.first(3, "empty_string_check", "'FAIL'", f"concat('{side} contains empty strings (first 3 of ', "
                             f"(SELECT count(*) {rest}), ')')", rest, column=f"'{c}'", **{p: "''''''"})
        yield self.passed("empty_string_check", "'No empty strings found'", [f"SELECT 1 {r}" for *_, r in empty])
        yield self.row("primary_key_match", verdict("s_only + t_only = 0"),
                       "concat('Common: ', common, ', Source-only: ', s_only, ', Target-only: ', t_only)",
                       s="common + s_only", t="common + t_only", rest="FROM m")
        for p, where, s, t in (("s", "Source but not in Target", "EXISTS", "MISSING"), ("t", "Target but not in Source", "MISSING", "EXISTS")):
            yield self.first(5, "primary_key_match", "'FAIL'", f"concat('Key exists in {where} (first 5 of ', "
                             f"(SELECT {p}_only FROM m), ')')", f"FROM {p}_only", s=f"'{s}'", t=f"'{t}'")
        differ = [(c, f"FROM {self.joined()} WHERE {test}") for c, test in sorted(self.tests.items())]
        for c, rest in differ:
            yield self.row("data_validation", "'FAIL'", f"concat(count(*), ' mismatches in column {c}')", f"'{c}'",
                           rest=f"{rest} HAVING count(*) > 0")
            rank = f"row_number() OVER (ORDER BY {', '.join(self.keys)})"
            yield self.first(3, "data_validation", "'FAIL'", f"concat('Value mismatch (example ', {rank}, ' of ', (SELECT count(*) {rest}), ')')",
                             rest, column=f"'{c}'", s=self.shown(c, "s."), t=self.shown(c, "t."))
        yield self.passed("data_validation", f"concat('All values match for ', common, ' common records across {common} columns')",
                          [f"SELECT 1 {r}" for _, r in differ], also="common > 0")
        if self.regression:
            yield from self.regression_parts(texts, counts, verdict)
        for side, p in (("source", "s"), ("target", "t")):
            for kind, c in self.rules:
                yield self.rule(kind, c, p, verdict)

    def regression_parts(self, texts, counts, verdict):
        yield self.row("column_order_check", "'PASS'", "'Column order matches'")
        yield self.row("column_specs_check", "'PASS'", "'All column specifications match'")
        distinct = [(c, f"FROM {counts(f'count(DISTINCT {c})')} WHERE s.a <> t.a") for c in self.columns]
        for c, rest in distinct:
            yield self.row("distinct_value_check", "'FAIL'", "'Distinct value count differs'", f"'{c}'", s="s.a", t="t.a", rest=rest)
        yield self.passed("distinct_value_check", "'All columns have matching distinct value counts'", [f"SELECT 1 {r}" for _, r in distinct])
        ranges = []
        for c in self.columns:
            if self.types[c] in TIME:
                ends = f"concat(strftime(min({c}), '%Y-%m-%d %H:%M:%S'), ' to ', strftime(max({c}), '%Y-%m-%d %H:%M:%S'))"
                ranges.append((c, f"FROM {counts(ends)} WHERE s.a <> t.a"))
        for c, rest in ranges:
            yield self.row("date_range_check", "'FAIL'", "'Date range mismatch'", f"'{c}'", s="s.a", t="t.a", rest=rest)
        yield self.passed("date_range_check", "'All date ranges match'", [f"SELECT 1 {r}" for _, r in ranges])
        hits = {
            "case_sensitivity_check": ("lower(s.{c}) = lower(t.{c}) AND s.{c} <> t.{c}", "Case difference detected",
                                       "No case sensitivity mismatches found"),
            "leading_zero_check": ("(starts_with(s.{c}, '0') <> starts_with(t.{c}, '0')) AND regexp_replace(s.{c}, '0', '') = regexp_replace(t.{c}, '0', '')",
                                   "Leading zero mismatch", "No leading zero mismatches found"),
            "special_char_check": ("(strlen(s.{c}) = length(s.{c})) <> (strlen(t.{c}) = length(t.{c}))",
                                   "Special/Unicode character difference detected", "No special character integrity issues found")}
        for check, (test, bad, good) in hits.items():
            found = [(c, f"FROM {self.joined()} WHERE {test.format(c=c)}") for c in texts]
            for c, rest in found:
                yield self.first(1, check, "'FAIL'", f"concat('{bad} (', (SELECT count(*) {rest}), ' rows)')", rest, column=f"'{c}'",
                                 s=f"s.{c}", t=f"t.{c}")
            yield self.passed(check, f"'{good}'", [f"SELECT 1 {r}" for _, r in found])
        hashed = lambda p: "md5(concat_ws('|', " + ", ".join(
            f"coalesce({self.text(c, p)}, 'nan')" for c in self.columns if c not in self.keys) + "))"
        rest = f"FROM {self.joined()} WHERE {hashed('s.')} <> {hashed('t.')}"
        yield self.first(5, "checksum_check", "'FAIL'", "'Row checksum mismatch'", rest, s=f"substr({hashed('s.')}, 1, 16)",
                         t=f"substr({hashed('t.')}, 1, 16)")
        yield self.row("checksum_check", "'INFO'", "concat('... and ', count(*) - 5, ' more checksum mismatches')", rest=f"{rest} HAVING count(*) > 5")
        yield self.passed("checksum_check", "concat('All ', common, ' row checksums match')", [f"SELECT 1 {rest}"])
        yield self.row("symmetric_difference_check", verdict("s_only + t_only = 0"),
                       "concat('Symmetric difference: ', s_only + t_only, ' records (Source-only: ', s_only, ', Target-only: ', t_only, ')')",
                       s="s_only", t="t_only", rest="FROM m")

    def rule(self, kind, c, p, verdict):
        if kind == "expect_column_values_to_not_be_null":
            return self.row("expectation", verdict("v = 0"), f"CASE WHEN v = 0 THEN 'Column ''{c}'': No NULL values' "
                            f"ELSE concat('Column ''{c}'': ', v, ' NULL value(s) found') END", f"'{c}'", s=f"'{kind}'", t="concat('NULL_count=', v)",
                            rest=f"FROM (SELECT count(*) - count({c}) AS v FROM {p}_all) AS x")
        return self.row("expectation", verdict("d = n"), f"CASE WHEN d = n THEN concat('Column ''{c}'': All ', n, ' values unique') "
                        f"ELSE concat('Column ''{c}'': ', n - d, ' duplicate(s)') END", f"'{c}'", s=f"'{kind}'",
                        t="concat('unique=', d, ',total=', n)", rest=f"FROM (SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM {p}_all) AS x")

    def sql(self, prefix=""):
        """The run's rows; `prefix` is a WITH list that the relations need."""
        start = prefix.rstrip() + ",\n" if prefix else "WITH "
        return start + ",\n".join(self.ctes) + "\n" + "\nUNION ALL ".join(self.parts())

    def summary(self, name):
        rows = self.sql()
        return (f"SELECT '{name}' AS validation_name, CASE WHEN count(*) FILTER (result = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS status, "
                f"CAST(count(*) FILTER (result = 'PASS') AS INTEGER) AS passed, CAST(count(*) FILTER (result = 'FAIL') AS INTEGER) AS failed, "
                f"CAST(count(*) AS INTEGER) AS total FROM ({rows}) AS run")
