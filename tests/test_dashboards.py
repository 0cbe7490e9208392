import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.operators import dashboards, images

SAMPLES = "dashboard_label string, dashboard_url string, iteration int, load_mode string, metric_type string, " \
          "chart_name string, value_ms double, rendered boolean"


@pytest.fixture(scope="module")
def samples(spark):
    full, chart, filt = dashboards.FULL, dashboards.CHART, dashboards.FILTER
    return spark.createDataFrame([
        ("A", "u", 1, "cold", full, "", 100.0, True), ("A", "u", 2, "cold", full, "", 300.0, True),
        ("A", "u", 1, "warm", full, "", 50.0, True), ("A", "u", 1, "cold", chart, "c1", 80.0, True),
        ("A", "u", 1, "cold", chart, "c2", 90.0, False), ("A", "u", 2, "warm", chart, "c1", 20.0, True),
        ("B", "u", 1, "warm", full, "", 70.0, True), ("B", "u", 1, "warm", filt, "Region", 9000.0, True)], SAMPLES)


def test_load_and_chart_stats(samples):
    r = {x.dashboard_label: x for x in dashboards.load_stats(samples).collect()}
    assert (r["A"].cold_min, r["A"].cold_max, r["A"].cold_avg, r["A"].warm_avg) == (100, 300, 200, 50)
    assert (r["B"].cold_min, r["B"].cold_avg, r["B"].warm_max) == (0, 0, 70)
    c = {x.chart_name: x for x in dashboards.chart_stats(samples).collect()}
    assert (c["c1"].cold_avg, c["c1"].warm_avg, c["c1"].max_ms, c["c2"].warm_avg) == (80, 20, 80, 0)


def test_thresholds(samples, spark):
    r = {x.dashboard_label: x for x in dashboards.dashboard_results(samples).collect()}
    assert (r["A"].cold_passed, r["A"].filter_passed, r["A"].passed, r["A"].chart_count) == (True, True, True, 2)
    assert (r["B"].cold_passed, r["B"].filter_passed, r["B"].max_ms) == (False, False, 9000)
    limits = spark.createDataFrame([("A", 150.0, 8000.0)], "dashboard_label string, first_render_ms double, interaction_ms double")
    r = {x.dashboard_label: x for x in dashboards.dashboard_results(samples, limits).collect()}
    assert not r["A"].cold_passed and r["B"].first_render_ms == 15000
    assert tuple(dashboards.run_rollup(dashboards.dashboard_results(samples)).first()) == (2, 1, 1, 2, 9000.0)


def test_slowest_and_report(samples):
    r = {(x.iteration, x.load_mode): x for x in dashboards.slowest_charts(samples).collect()}
    assert (r[1, "cold"].slowest_chart, r[1, "cold"].chart_count) == ("c2", 2)
    report = {(x.metric_type, x.iteration, x.load_mode, x.chart_name): x["pass"] for x in dashboards.timing_report(samples).collect()}
    assert report[dashboards.CHART, 1, "cold", "c2"] == "NOT_RENDERED"
    assert report[dashboards.FILTER, 1, "warm", "Region"] == "False"
    assert report[dashboards.FULL, 1, "cold", ""] == "True"


def test_style_violations(spark):
    e = spark.createDataFrame([("t", "x", "Arial, sans-serif", "12px", "#FF0000"), ("t", "y", "Comic", "13px", "red"),
                               ("u", "z", "", "", "#00ff00")],
                              "tab string, text string, font_family string, font_size string, color string")
    bad = dashboards.style_violations(e, ["arial"], ["12PX"], ["#ff0000"])
    assert sorted((r.text, r.violation_type, r.found) for r in bad.collect()) == [
        ("y", "font_family", "Comic"), ("y", "font_size", "13px"), ("z", "color", "#00FF00")]
    ok = spark.createDataFrame([("v", "w", "Arial", "12px", "")], e.schema)
    tabs = {r.tab: (r.violations, r.passed) for r in dashboards.tab_results(e.union(ok), bad).collect()}
    assert tabs == {"t": (2, False), "u": (1, False), "v": (0, True)}


def pages(spark, names):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "workbook int, ordinal int, name string")


def test_page_alignment_and_sequence(spark):
    a, b = pages(spark, ["Home", "Sales", "Old", "Costs"]), pages(spark, ["home", "Costs", "SALES", "New"])
    r = dashboards.align_pages(a, b, "P", "Q", ["old"]).collect()
    assert [(x.page, x.matched, x.reason) for x in r] == [
        ("Home", True, ""), ("Sales", True, ""), ("Old", False, "Deprecated page (configured hint): Missing in Q"),
        ("Costs", True, ""), ("New", False, "Possible deprecated page (auto-detected): Missing in P")]
    s = {x.page_key: (x.position_a, x.position_b, x.in_order) for x in dashboards.page_sequence(a, b).collect()}
    assert s == {"home": (1, 1, True), "sales": (2, 3, False), "costs": (3, 2, False)}


def test_grouped_rank_spans_windows(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id"), F.lit("x").alias("tie"))
    ranked = dashboards.grouped_rank(df, "g", "id", "tie", "r", width=17)
    seen = {}
    for row in sorted(ranked.collect(), key=lambda x: x.id):
        seen[row.g] = seen.get(row.g, 0) + 1
        assert row.r == seen[row.g]


def png(pixels):
    """A gray PNG file of the given pixels."""
    h, w = pixels.shape
    chunk = lambda kind, data: (len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big"))
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    body = b"".join(b"\0" + bytes(row) for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (20, 30))
    changed = base.copy()
    changed[5:15, 5:20] = 255 - changed[5:15, 5:20]
    for folder, second in (("a", base), ("b", changed)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.png").write_bytes(png(base))
        (tmp_path / folder / "other.png").write_bytes(png(second))
    pairs = images.image_pairs(images.read_images(spark, str(tmp_path / "a")), images.read_images(spark, str(tmp_path / "b")))
    r = {x.name: x for x in images.image_diff(pairs).collect()}
    assert (r["same.png"].ssim_score, r["same.png"].diff_pixels, r["same.png"].passed) == (1.0, 0, True)
    assert r["other.png"].ssim_score < 0.9 and r["other.png"].diff_pixels == (changed != base).sum()
    assert tuple(dashboards.compare_summary(images.image_diff(pairs)).first())[:3] == (2, 1, 1)


def test_images_of_other_size_are_resized(spark):
    rows = [("x", 16, 16, 1, bytes([100] * 256), 8, 8, 1, bytes([100] * 64))]
    df = spark.createDataFrame(rows, "name string, h int, w int, c int, d binary, h2 int, w2 int, c2 int, d2 binary")
    side = lambda h, w, c, d: df.select("name", F.col(h).alias("height"), F.col(w).alias("width"), F.col(c).alias("channels"), F.col(d).alias("data"))
    r = images.image_diff(images.image_pairs(side("h", "w", "c", "d"), side("h2", "w2", "c2", "d2"))).first()
    assert (r.ssim_score, r.diff_pixels) == (1.0, 0)
