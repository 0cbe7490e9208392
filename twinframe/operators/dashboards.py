"""Analytics over recorded dashboard tests: load times, styling, page lists, result totals.

`samples` is one row per measurement: dashboard_label, dashboard_url,
iteration, load_mode (cold/warm), metric_type, chart_name, value_ms, rendered.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.functions.values import allows_exact, allows_part
from twinframe.operators.keys import salted_left_join

FULL, CHART, FILTER = "full_dashboard_load", "chart_load", "filter_refresh"
FIRST_RENDER_MS, INTERACTION_MS = 15000.0, 8000.0  # fixed values: default limits
SMALL = 100_000  # limits that are broadcast
# Reasons that readers of reports look for.
HINTED_PAGE, GUESSED_PAGE = "Deprecated page (configured hint): ", "Possible deprecated page (auto-detected): "


def _zero(c):
    return F.coalesce(c, F.lit(0.0))


def _when(metric, mode=None, value="value_ms"):
    test = F.col("metric_type") == metric
    if mode:
        test = test & (F.col("load_mode") == mode)
    return F.when(test, F.col(value))


def load_stats(samples):
    """Min, max and average full load per dashboard, cold and warm; zero without samples."""
    full = samples.where(F.col("metric_type") == FULL)
    aggs = []
    for mode in ("cold", "warm"):
        v = _when(FULL, mode)
        aggs += [_zero(F.min(v)).alias(f"{mode}_min"), _zero(F.max(v)).alias(f"{mode}_max"),
                 _zero(F.avg(v)).alias(f"{mode}_avg")]
    return full.groupBy("dashboard_label").agg(*aggs)


def chart_stats(samples):
    """Cold average, warm average and maximum per chart, with the iteration it was first seen in."""
    charts = samples.where(F.col("metric_type") == CHART)
    return charts.groupBy("dashboard_label", "chart_name").agg(
        _zero(F.avg(_when(CHART, "cold"))).alias("cold_avg"), _zero(F.avg(_when(CHART, "warm"))).alias("warm_avg"),
        F.max("value_ms").alias("max_ms"))


def charts_in_order(samples, order="iteration"):
    """Charts of every dashboard by first appearance."""
    return (samples.where(F.col("metric_type") == CHART).groupBy("dashboard_label", "chart_name")
            .agg(F.min(order).alias("first_seen")).orderBy("dashboard_label", "first_seen", "chart_name"))


def dashboard_results(samples, thresholds=None):
    """One row per dashboard: full-load and filter averages, chart count, limits, pass flags, overall maximum."""
    # Measurements are combined per chart before they are combined per dashboard.
    per_chart = samples.groupBy("dashboard_label", "metric_type", "chart_name").agg(
        *[agg for mode in ("cold", "warm") for agg in (
            F.sum(F.when(F.col("load_mode") == mode, F.col("value_ms"))).alias(f"{mode}_sum"),
            F.count_if(F.col("load_mode") == mode).alias(f"{mode}_n"))],
        F.sum("value_ms").alias("sum_ms"), F.count(F.lit(1)).alias("n"), F.max("value_ms").alias("max_ms"))
    part = lambda metric, c: F.sum(F.when(F.col("metric_type") == metric, F.col(c)))
    avg = lambda total, n: F.when(n > 0, total / n)
    rows = per_chart.groupBy("dashboard_label").agg(
        avg(part(FULL, "cold_sum"), part(FULL, "cold_n")).alias("cold_avg"),
        avg(part(FULL, "warm_sum"), part(FULL, "warm_n")).alias("warm_avg"),
        avg(part(FILTER, "sum_ms"), part(FILTER, "n")).alias("filter_avg"),
        F.count_if(F.col("metric_type") == CHART).alias("chart_count"),
        _zero(F.max("max_ms")).alias("max_ms"))
    if thresholds is not None:
        rows = rows.join(thresholds.select("dashboard_label", "first_render_ms", "interaction_ms"),
                         "dashboard_label", "left")
    limit = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if thresholds is not None else F.lit(default)
    rows = (rows.withColumn("first_render_ms", limit("first_render_ms", FIRST_RENDER_MS))
            .withColumn("interaction_ms", limit("interaction_ms", INTERACTION_MS)))
    cold = F.coalesce(F.col("cold_avg") <= F.col("first_render_ms"), F.lit(False))
    filt = F.coalesce(F.col("filter_avg") <= F.col("interaction_ms"), F.lit(True))
    return (rows.withColumn("cold_passed", cold).withColumn("filter_passed", filt).withColumn("passed", cold & filt)
            .withColumns({c: _zero(F.col(c)) for c in ("cold_avg", "warm_avg", "filter_avg")}))


def overall_max(samples):
    """Longest time of any kind per dashboard, and the longest of each kind."""
    return samples.groupBy("dashboard_label").agg(
        _zero(F.max(_when(FULL))).alias("full_max"), _zero(F.max(_when(CHART))).alias("chart_max"),
        _zero(F.max(_when(FILTER))).alias("filter_max")).withColumn(
        "max_ms", F.greatest("full_max", "chart_max", "filter_max"))


def run_rollup(results):
    return results.agg(
        F.count(F.lit(1)).alias("dashboards"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.sum("chart_count"), F.lit(0)).alias("total_charts"),
        _zero(F.max("max_ms")).alias("overall_max_ms"))


def slowest_charts(samples):
    """Slowest chart, its time and the chart count of every load pass."""
    return (samples.where(F.col("metric_type") == CHART).groupBy("dashboard_label", "iteration", "load_mode")
            .agg(F.max(F.struct("value_ms", "chart_name")).alias("top"), F.count(F.lit(1)).alias("chart_count"))
            .select("dashboard_label", "iteration", "load_mode", F.col("top.chart_name").alias("slowest_chart"),
                    F.col("top.value_ms").alias("slowest_ms"), "chart_count"))


def timing_report(samples, thresholds=None):
    """All measurements in the long report form with limit and pass columns as text."""
    if thresholds is not None:
        small = thresholds.limit(SMALL + 1).count() <= SMALL
        samples = (samples.join(F.broadcast(thresholds), "dashboard_label", "left") if small
                   else salted_left_join(samples, thresholds, "dashboard_label"))
        first, inter = (F.coalesce(c, F.lit(d)) for c, d in (
            (F.col("first_render_ms"), FIRST_RENDER_MS), (F.col("interaction_ms"), INTERACTION_MS)))
    else:
        first, inter = F.lit(FIRST_RENDER_MS), F.lit(INTERACTION_MS)
    kind, value = F.col("metric_type"), F.col("value_ms")
    cold_load = (kind == FULL) & (F.col("load_mode") == "cold")
    whole = lambda c: F.round(c, 0).cast("bigint").cast("string")
    verdict = lambda ok: F.when(ok, F.lit("True")).otherwise(F.lit("False"))
    return samples.select(
        "dashboard_label", "dashboard_url", "iteration",
        F.when(kind == FILTER, F.lit("warm")).otherwise(F.col("load_mode")).alias("load_mode"), "metric_type",
        F.when(kind == FULL, F.lit("")).otherwise(F.col("chart_name")).alias("chart_name"),
        whole(value).alias("value_ms"),
        F.when(cold_load, whole(first)).when(kind == FILTER, whole(inter)).otherwise(F.lit("")).alias("threshold_ms"),
        F.when(cold_load, verdict(value <= first)).when(kind == FILTER, verdict(value <= inter))
        .when((kind == CHART) & ~F.col("rendered"), F.lit("NOT_RENDERED")).otherwise(F.lit("")).alias("pass"))


def style_violations(elements, fonts, sizes, colors):
    """One row per broken styling rule of every text element (font_family, font_size, color)."""
    font, size, color = F.col("font_family"), F.col("font_size"), F.upper(F.col("color"))
    broken = lambda kind, found, rule: F.when(rule, F.struct(F.lit(kind).alias("violation_type"), found.alias("found")))
    return elements.select("*", F.inline(F.array_compact(F.array(
        broken("font_family", font, (font != "") & ~allows_part(font, fonts)),
        broken("font_size", size, (size != "") & ~allows_exact(size, sizes)),
        broken("color", color, color.startswith("#") & ~allows_exact(color, colors))))))


def tab_results(elements, violations, tab="tab"):
    """Violations per tab; a tab without any passes."""
    counts = violations.groupBy(tab).agg(F.count(F.lit(1)).alias("violations"))
    return (elements.select(tab).distinct().join(counts, tab, "left")
            .select(tab, F.coalesce("violations", F.lit(0)).alias("violations"))
            .withColumn("passed", F.col("violations") == 0))


def _page_list(pages, prefix):
    """First page of each name (ignoring case) in a workbook."""
    return (pages.groupBy("workbook", F.lower("name").alias("page_key"))
            .agg(F.min(F.struct("ordinal", "name")).alias("p"))
            .select("workbook", "page_key", F.col("p.ordinal").alias(f"ordinal_{prefix}"),
                    F.col("p.name").alias(f"name_{prefix}")))


def align_pages(pages_a, pages_b, label_a="Dashboard 1", label_b="Dashboard 2", deprecated=()):
    """Pages (workbook, ordinal, name) of two dashboards matched by name, with the reason where one lacks it.

    Ordered as in A, followed by the pages only B has.
    """
    both = _page_list(pages_a, "a").join(_page_list(pages_b, "b"), ["workbook", "page_key"], "full_outer")
    in_a, in_b = F.col("ordinal_a").isNotNull(), F.col("ordinal_b").isNotNull()
    missing = F.when(~in_b, F.lit(f"Missing in {label_b}")).when(~in_a, F.lit(f"Missing in {label_a}"))
    hinted = F.trim("page_key").isin([str(d).strip().lower() for d in deprecated]) if deprecated else F.lit(False)
    label = F.when(hinted, F.lit(HINTED_PAGE)).otherwise(F.lit(GUESSED_PAGE))
    return (both.select("workbook", F.coalesce("name_a", "name_b").alias("page"), "ordinal_a", "ordinal_b",
                        (in_a & in_b).alias("matched"), F.coalesce(F.concat(label, missing), F.lit("")).alias("reason"))
            .orderBy("workbook", F.col("ordinal_a").asc_nulls_last(), "ordinal_b"))


def grouped_rank(df, group, order, tie, name, width=100_000):
    """Rank by a whole-number order (and `tie`) within a group, in windows of bounded size.

    Rows are numbered inside stretches of `width` order values; the sizes of
    the stretches before are added. A group of any size thus spreads over many
    tasks.
    """
    parts = df.withColumn("__part", F.floor(F.col(order) / width))
    sizes = parts.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order, tie))
    return (parts.withColumn("__in", inside).join(offsets, [group, "__part"])
            .withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before"))


def page_sequence(pages_a, pages_b):
    """Position among the common pages on each side; they differ where the order does."""
    both = _page_list(pages_a, "a").join(_page_list(pages_b, "b"), ["workbook", "page_key"])
    ranked = grouped_rank(grouped_rank(both, "workbook", "ordinal_a", "page_key", "position_a"),
                          "workbook", "ordinal_b", "page_key", "position_b")
    return ranked.select("workbook", "page_key", "position_a", "position_b",
                         (F.col("position_a") == F.col("position_b")).alias("in_order"))


def compare_summary(results):
    """Total, passed, failed and the mean of the positive similarity scores."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.round(F.avg(F.when(F.col("ssim_score") > 0, F.col("ssim_score"))), 4).alias("avg_ssim"))
