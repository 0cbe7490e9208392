"""Validations from a configuration, one by one or as a suite."""

import copy
import logging

from pyspark.sql import functions as F

from twinframe.operators.align import AlignmentRules, clean_name
from twinframe.operators.summaries import consolidate
from twinframe.plans.validation import Options, validate
from twinframe.shared import written
from twinframe.sinks import write_report
from twinframe.sources.files import read_file
from twinframe.sources.tables import read_table
from twinframe.sources.workbooks import embedded_rows, match_source, read_archives, workbook_catalog

log = logging.getLogger(__name__)

FILE_SETTINGS = ["sep", "encoding", "format", "json_orient"]


def load_dataset(spark, config):
    """The frame a source or target entry of a configuration describes."""
    kind = str(config.get("type", "")).lower()
    if kind == "file":
        return read_file(spark, config["path"], config.get("format"), config.get("sep", ","),
                         config.get("encoding"), config.get("json_orient", "records"), config.get("multi_line", True))
    if kind == "table":
        return read_table(spark, config.get("table"), config.get("query"), config.get("jdbc"), config.get("schema"),
                          config.get("columns"), config.get("where_clause", config.get("where")),
                          config.get("limit", config.get("row_limit")))
    if kind == "datasource":
        archives = read_archives(spark, config["path"])
        if config.get("extract_data", True):
            if config.get("datasource_name"):
                wanted = match_source(workbook_catalog(archives), config["datasource_name"]).select("path")
                archives = archives.join(wanted, "path", "left_semi")
            rows = written(embedded_rows(archives), "embedded")
            names = rows.select(F.explode(F.map_keys("cells")).alias("n")).distinct()
            columns = sorted(r.n for r in names.collect())  # as many as the data has columns
            if columns:
                return rows.select(*[F.col("cells").getItem(c).alias(c) for c in columns])
        listed = workbook_catalog(archives)
        if config.get("datasource_name"):
            listed = listed.where(F.col("datasource_name") == config["datasource_name"])
        return listed.select("datasource_name", "column_name", "datatype", "raw_name")
    raise ValueError(f"unknown dataset type '{kind}', expected file, table or datasource")


def options_from(config):
    sample = config.get("quick_sample_pks")
    if sample is not None and (not str(sample).isdigit() or int(sample) <= 0):
        raise ValueError(f"'quick_sample_pks' wants a whole number above 0, not {sample!r}")
    rules = config.get("expectations") or config.get("great_expectations") or []
    if not isinstance(rules, dict):
        rules = {"expectations": rules}
    on, expected = rules.get("run_on", "both"), rules.get("expectations") or []
    expected = [{**r, "column": clean_name(r["column"])} if r.get("column") else r for r in expected]
    anomaly = config.get("anomaly_detection") or {}
    return Options(
        name=config.get("name", "Validation"), regression=bool(config.get("regression", False)),
        rules=AlignmentRules.from_config(config), key_mode=config.get("key_mode", "canonical"),
        strict_columns=bool(config.get("strict_columns", False)),
        sample_keys=int(sample) if sample is not None else None,
        sample_seed=int(config.get("quick_sample_seed", 42)),
        filter_target=bool(config.get("filter_target_by_source_pks", False)),
        approx_distinct=bool(config.get("approx_distinct", False)), hash_algo=config.get("hash_algo", "md5"),
        expectations=expected if rules.get("enabled", True) else [], expectations_on=on,
        anomaly=anomaly if anomaly.get("enabled", True) else {})


def run_validation(spark, config):
    """Load both sides of one configured validation and check them."""
    sides = {}
    for side in ("source", "target"):
        entry = dict(config.get(side) or {})
        for setting in FILE_SETTINGS:
            if setting in config:
                entry.setdefault(setting, config[setting])
        sides[side] = load_dataset(spark, entry)
    return validate(sides["source"], sides["target"], config.get("primary_keys"), options_from(config))


def run_suite(spark, config, only=None, target_limit=None, sample=None, output_dir=None):
    """Run the validations of a configuration; returns (outcomes, consolidated results).

    `target_limit` caps target tables and `sample` the number of source keys,
    for quick runs. Results are written to `output_dir`, or else to the folder
    a validation names itself.
    """
    validations = [v for v in config.get("validations") or [] if only is None or v.get("name") == only]
    if not validations:
        raise ValueError(f"validation '{only}' not found" if only else "no validations in the configuration")
    outcomes, folders = [], []
    for entry in copy.deepcopy(validations):
        folders.append(output_dir or entry.get("output_dir"))
        target = entry.get("target") or {}
        if target_limit is not None and str(target.get("type", "")).lower() == "table":
            target["limit"] = target_limit
        if sample is not None:
            entry["quick_sample_pks"] = sample
        outcomes.append(run_validation(spark, entry))
    results = consolidate([(o.name, o.results) for o in outcomes])
    for o, folder in zip(outcomes, folders):
        if folder:
            write_report(o.results, folder, o.name)
    if len(outcomes) > 1 and folders[0]:
        write_report(results, folders[0], "consolidated")
    return outcomes, results


def load_config(path):
    import yaml
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def summary_frame(spark, outcomes):
    return spark.createDataFrame(
        [tuple(o.summary().values()) for o in outcomes],
        "validation_name string, status string, passed int, failed int, total int")


COUNT_SCHEMA = ("name string, csv_file string, csv_rows string, csv_cols string, table string, table_rows string, "
                "table_cols string, rows_match string, cols_match string, status string")


def run_count_check(spark, config):
    """Row and column counts of the sources and targets of a configuration.

    A side that cannot be read gives a row marked ERROR instead of counts.
    """
    def size(entry):
        try:
            df = load_dataset(spark, entry)
            return df.count(), len(df.columns)
        except Exception as e:  # whatever the reader raises belongs in the report
            log.error("cannot count %s: %s", entry, e)
            return None

    rows = []
    for i, entry in enumerate(config.get("validations") or [], 1):
        source, target = entry.get("source") or {}, entry.get("target") or {}
        s = size(source)
        t = size(target) if s else None
        if s and t:
            same = [a == b for a, b in zip(s, t)]
            cells = [*s, *t, *("YES" if ok else "NO" for ok in same), "PASSED" if all(same) else "FAILED"]
        else:
            cells = [*(s or ("ERROR", "ERROR")), *(("ERROR",) * 2 if s else ("N/A",) * 2), "ERROR", "ERROR", "FAILED"]
        named = [entry.get("name", f"validation_{i}"), source.get("path", ""), *cells[:2],
                 target.get("table") or target.get("path", ""), *cells[2:]]
        rows.append(tuple(str(c) for c in named))
    return spark.createDataFrame(rows, COUNT_SCHEMA)
