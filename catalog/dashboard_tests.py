"""Recorded dashboard timings, styling, page lists and screenshots."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog.registry import frame, query, table, with_views
from twinframe.functions.values import rgb_to_hex
from twinframe.operators import dashboards, images


def samples(spark, sf):
    return frame(spark, sf, "samples")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


SAMPLES = with_views("samples")
_MODES = ", ".join(
    f"round(coalesce({fn}(value_ms) FILTER (load_mode = '{m}'), 0), 4) AS {m}_{fn}"
    for m in ("cold", "warm") for fn in ("min", "max", "avg"))


@query("perf_load_stats", SAMPLES + f"""
SELECT dashboard_label, {_MODES} FROM samples WHERE metric_type = 'full_dashboard_load' GROUP BY dashboard_label""")
def perf_load_stats(spark, sf):
    return _rounded(dashboards.load_stats(samples(spark, sf)), *[f"{m}_{x}" for m in ("cold", "warm") for x in ("min", "max", "avg")])


@query("perf_chart_stats", SAMPLES + """
SELECT dashboard_label, chart_name, round(coalesce(avg(value_ms) FILTER (load_mode = 'cold'), 0), 4) AS cold_avg,
  round(coalesce(avg(value_ms) FILTER (load_mode = 'warm'), 0), 4) AS warm_avg, max(value_ms) AS max_ms
FROM samples WHERE metric_type = 'chart_load' GROUP BY 1, 2""")
def perf_chart_stats(spark, sf):
    return _rounded(dashboards.chart_stats(samples(spark, sf)), "cold_avg", "warm_avg")


RESULTS = with_views("samples", "limits") + """
, d AS (SELECT dashboard_label,
    avg(value_ms) FILTER (metric_type = 'full_dashboard_load' AND load_mode = 'cold') AS cold,
    avg(value_ms) FILTER (metric_type = 'full_dashboard_load' AND load_mode = 'warm') AS warm,
    avg(value_ms) FILTER (metric_type = 'filter_refresh') AS filt,
    count(DISTINCT chart_name) FILTER (metric_type = 'chart_load') AS chart_count, max(value_ms) AS max_ms
  FROM samples GROUP BY 1),
r AS (SELECT d.*, coalesce(first_render_ms, 15000) AS fr, coalesce(interaction_ms, 8000) AS ia
  FROM d LEFT JOIN limits USING (dashboard_label)),
v AS (SELECT *, coalesce(cold <= fr, FALSE) AS cold_passed, coalesce(filt <= ia, TRUE) AS filter_passed FROM r)
"""


def results(spark, sf):
    return dashboards.dashboard_results(samples(spark, sf), frame(spark, sf, "limits"))


@query("perf_thresholds", RESULTS + """
SELECT dashboard_label, round(coalesce(cold, 0), 4) AS cold_avg, round(coalesce(filt, 0), 4) AS filter_avg, chart_count,
  cold_passed, filter_passed, cold_passed AND filter_passed AS passed FROM v""")
def perf_thresholds(spark, sf):
    return _rounded(results(spark, sf), "cold_avg", "filter_avg").select(
        "dashboard_label", "cold_avg", "filter_avg", "chart_count", "cold_passed", "filter_passed", "passed")


@query("perf_overall_max", SAMPLES + """
SELECT dashboard_label, coalesce(max(value_ms) FILTER (metric_type = 'full_dashboard_load'), 0) AS full_max,
  coalesce(max(value_ms) FILTER (metric_type = 'chart_load'), 0) AS chart_max,
  coalesce(max(value_ms) FILTER (metric_type = 'filter_refresh'), 0) AS filter_max, max(value_ms) AS max_ms
FROM samples GROUP BY 1""")
def perf_overall_max(spark, sf):
    return dashboards.overall_max(samples(spark, sf))


@query("perf_run_rollup", RESULTS + """
SELECT count(*) AS dashboards, count(*) FILTER (cold_passed AND filter_passed) AS passed,
  count(*) FILTER (NOT (cold_passed AND filter_passed)) AS failed, CAST(sum(chart_count) AS BIGINT) AS total_charts,
  max(max_ms) AS overall_max_ms FROM v""")
def perf_run_rollup(spark, sf):
    return dashboards.run_rollup(results(spark, sf))


@query("perf_slowest_chart", SAMPLES + """
SELECT dashboard_label, iteration, load_mode, arg_max(chart_name, (value_ms, chart_name)) AS slowest_chart,
  max(value_ms) AS slowest_ms, count(*) AS chart_count FROM samples WHERE metric_type = 'chart_load'
GROUP BY 1, 2, 3""")
def perf_slowest_chart(spark, sf):
    return dashboards.slowest_charts(samples(spark, sf))


@query("win_first_seen_order", SAMPLES + """
SELECT dashboard_label, chart_name, min(iteration) AS first_seen FROM samples WHERE metric_type = 'chart_load' GROUP BY 1, 2""")
def win_first_seen_order(spark, sf):
    return dashboards.charts_in_order(samples(spark, sf))


# The allow-lists of the styling queries.
FONTS, SIZES, COLORS = ["arial", "Tableau"], ["8px", "9PX", "11px"], ["#000000", "#64ff00", "#C80000"]


def elements(spark, sf):
    return frame(spark, sf, "elements").withColumn("color", rgb_to_hex(F.col("rgb"))).drop("rgb")


VIOLATIONS = with_views("elements") + """
, hexed AS (SELECT *, CASE WHEN rgb LIKE 'rgb%' THEN printf('#%02X%02X00', element % 3 * 100,
    CAST(regexp_extract(rgb, ', ([0-9]+),', 1) AS INT)) ELSE rgb END AS color FROM elements),
bad AS (
  SELECT tab, element, text, 'font_family' AS violation_type, font_family AS found FROM hexed
    WHERE font_family <> '' AND NOT contains(lower(font_family), 'arial') AND NOT contains(lower(font_family), 'tableau')
  UNION ALL SELECT tab, element, text, 'font_size', font_size FROM hexed WHERE font_size NOT IN ('8px', '9px', '11px')
  UNION ALL SELECT tab, element, text, 'color', color FROM hexed
    WHERE starts_with(color, '#') AND color NOT IN ('#000000', '#64FF00', '#C80000'))
"""


@query("ui_violations", VIOLATIONS + "SELECT * FROM bad")
def ui_violations(spark, sf):
    return dashboards.style_violations(elements(spark, sf), FONTS, SIZES, COLORS).select(
        "tab", "element", "text", "violation_type", "found")


@query("ui_tab_results", VIOLATIONS + """
SELECT tab, count(violation_type) AS violations, count(violation_type) = 0 AS passed
FROM (SELECT DISTINCT tab FROM elements) AS tabs LEFT JOIN bad USING (tab) GROUP BY tab""")
def ui_tab_results(spark, sf):
    found = elements(spark, sf)
    return dashboards.tab_results(found, dashboards.style_violations(found, FONTS, SIZES, COLORS))


PAGES = with_views("pages_a", "pages_b") + """
, a AS (SELECT workbook, lower(name) AS k, min(ordinal) AS ordinal_a, arg_min(name, ordinal) AS name_a FROM pages_a GROUP BY 1, 2),
b AS (SELECT workbook, lower(name) AS k, min(ordinal) AS ordinal_b, arg_min(name, ordinal) AS name_b FROM pages_b GROUP BY 1, 2)
"""
_REASON = """CASE WHEN ordinal_a IS NOT NULL AND ordinal_b IS NOT NULL THEN ''
  ELSE concat(CASE WHEN k = 'page 6' THEN 'Deprecated page (configured hint): ' ELSE 'Possible deprecated page (auto-detected): ' END,
    CASE WHEN ordinal_b IS NULL THEN 'Missing in Beta' ELSE 'Missing in Alpha' END) END AS reason"""


def page_lists(spark, sf):
    return frame(spark, sf, "pages_a"), frame(spark, sf, "pages_b")


@query("join_pages", PAGES + """
SELECT workbook, coalesce(name_a, name_b) AS page, ordinal_a, ordinal_b FROM a FULL JOIN b USING (workbook, k)""")
def join_pages(spark, sf):
    return dashboards.align_pages(*page_lists(spark, sf)).select("workbook", "page", "ordinal_a", "ordinal_b")


@query("page_alignment", PAGES + f"""
SELECT workbook, coalesce(name_a, name_b) AS page, ordinal_a IS NOT NULL AND ordinal_b IS NOT NULL AS matched, {_REASON}
FROM a FULL JOIN b USING (workbook, k)""")
def page_alignment(spark, sf):
    return dashboards.align_pages(*page_lists(spark, sf), "Alpha", "Beta", [" Page 6 "]).select(
        "workbook", "page", "matched", "reason")


RANKS = PAGES + """
, ranked AS (SELECT workbook, k AS page_key, row_number() OVER (PARTITION BY workbook ORDER BY ordinal_a, k) AS position_a,
  row_number() OVER (PARTITION BY workbook ORDER BY ordinal_b, k) AS position_b FROM a JOIN b USING (workbook, k))
"""


@query("win_rank_pages", RANKS + "SELECT workbook, page_key, position_a, position_b FROM ranked")
def win_rank_pages(spark, sf):
    return dashboards.page_sequence(*page_lists(spark, sf)).select("workbook", "page_key", "position_a", "position_b")


@query("page_sequence", RANKS + """
SELECT workbook, count(*) AS common_pages, count(*) FILTER (position_a <> position_b) AS moved FROM ranked GROUP BY 1""")
def page_sequence(spark, sf):
    return dashboards.page_sequence(*page_lists(spark, sf)).groupBy("workbook").agg(
        F.count(F.lit(1)).alias("common_pages"), F.count_if(~F.col("in_order")).alias("moved"))


def screenshots(spark, sf):
    """An 8 x 8 gray image per embedding; the target images of some labels are dimmed or inverted."""
    vectors = table(spark, sf, "embeddings")

    def draw(batches):
        for batch in batches:
            gray = [np.floor((np.asarray(v, dtype=float) + 1) * 127).astype(np.int64) for v in batch["embedding"]]
            changed = [255 - g if k % 5 == 1 else np.maximum(g - 9, 0) if k % 5 == 2 else g
                       for g, k in zip(gray, batch["label"])]
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "height": 8, "width": 8, "channels": 1,
                "data": [g.astype(np.uint8).tobytes() for g in gray],
                "other": [g.astype(np.uint8).tobytes() for g in changed]})

    drawn = vectors.mapInPandas(draw, "vec_id bigint, height int, width int, channels int, data binary, other binary")
    return drawn.drop("other"), drawn.drop("data").withColumnRenamed("other", "data")


IMAGES = """
WITH px AS (SELECT vec_id, label, CAST(floor((CAST(e AS DOUBLE) + 1) * 127) AS BIGINT) AS a, i // 8 AS y, i % 8 AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) AS u),
pair AS (SELECT vec_id, y, x, a, CASE WHEN label % 5 = 1 THEN 255 - a WHEN label % 5 = 2 THEN greatest(a - 9, 0) ELSE a END AS b FROM px),
corner AS (SELECT oy, ox FROM (VALUES (0), (1)) AS r(oy), (VALUES (0), (1)) AS c(ox)),
box AS (SELECT vec_id, oy, ox, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS maa, avg(b * b) AS mbb, avg(a * b) AS mab
  FROM pair JOIN corner ON y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY 1, 2, 3),
moments AS (SELECT *, 49.0 / 48 * (maa - ma * ma) AS va, 49.0 / 48 * (mbb - mb * mb) AS vb, 49.0 / 48 * (mab - ma * mb) AS cab FROM box),
scored AS (SELECT vec_id, round(avg((2 * ma * mb + 6.5025) * (2 * cab + 58.5225)
  / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 4) AS ssim_score FROM moments GROUP BY 1),
diffs AS (SELECT vec_id, count(*) FILTER (a <> b) AS diff_pixels FROM pair GROUP BY 1)
"""


@query("image_diff", IMAGES + """
SELECT vec_id, ssim_score, diff_pixels, ssim_score >= 0.98 AS passed FROM scored JOIN diffs USING (vec_id)""")
def image_diff(spark, sf):
    return images.image_diff(images.image_pairs(*screenshots(spark, sf), ["vec_id"]), ["vec_id"]).drop("changed_area", "regions")


@query("compare_summary", IMAGES + """
SELECT count(*) AS total, count(*) FILTER (ssim_score >= 0.98) AS passed, count(*) FILTER (ssim_score < 0.98) AS failed,
  round(avg(ssim_score) FILTER (ssim_score > 0), 4) AS avg_ssim FROM scored""")
def compare_summary(spark, sf):
    return dashboards.compare_summary(image_diff(spark, sf))
