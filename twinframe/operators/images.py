"""Similarity of screenshot pairs, and the regions in which they differ: one image pair per row, compared inside the tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from twinframe.operators.regions import outer_regions

# Structural similarity as usually defined for 8-bit images.
WINDOW, K1, K2, RANGE = 7, 0.01, 0.03, 255.0
PASS_SCORE = 0.98
# Fixed value: regions of at most so much area are noise.
NOISE = 30
# Luma weights of blue, green and red.
LUMA_BGR = (0.114, 0.587, 0.299)
#: Plan setting only: pixels of one size that are compared together.
TOGETHER = 1 << 22

REGION = "struct<x:int,y:int,width:int,height:int,area:double>"
DIFF_SCHEMA = f"ssim_score double, diff_pixels bigint, passed boolean, changed_area bigint, regions array<{REGION}>"


def read_images(spark, path):
    """Images of a folder as (name, height, width, channels, data); the name is the path below the folder."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    folder = path.split(":", 1)[-1].strip("/") + "/"
    return images.select(F.substring_index("origin", folder, -1).alias("name"),
                         "height", "width", F.col("nChannels").alias("channels"), "data")


def image_pairs(baseline, target, keys=("name",)):
    """Baseline and target images joined on their name."""
    fields = ["height", "width", "channels", "data"]
    side = lambda df, p: df.select(*keys, F.struct(*fields).alias(p))
    return side(baseline, "baseline").join(side(target, "target"), list(keys))


def gray(image):
    pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], -1)
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(float)
    return np.rint(pixels[:, :, :3] @ np.array(LUMA_BGR))


def resize(pixels, shape):
    if pixels.shape == shape:
        return pixels
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, pixels.shape)]
    lo = [np.floor(a).astype(int) for a in at]
    hi = [np.minimum(i + 1, m - 1) for i, m in zip(lo, pixels.shape)]
    wy, wx = (at[0] - lo[0])[:, None], (at[1] - lo[1])[None, :]
    upper = pixels[np.ix_(lo[0], lo[1])] * (1 - wx) + pixels[np.ix_(lo[0], hi[1])] * wx
    lower = pixels[np.ix_(hi[0], lo[1])] * (1 - wx) + pixels[np.ix_(hi[0], hi[1])] * wx
    return np.rint(upper * (1 - wy) + lower * wy)


def means(values):
    """Mean of the window around every pixel of a stack of images, from one summed-area table; edges are mirrored."""
    half = WINDOW // 2
    wide = np.pad(values, ((0, 0), (half, half), (half, half)), mode="symmetric")
    sums = np.pad(wide, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
    boxes = sums[:, WINDOW:, WINDOW:] - sums[:, :-WINDOW, WINDOW:] - sums[:, WINDOW:, :-WINDOW] + sums[:, :-WINDOW, :-WINDOW]
    return boxes / WINDOW ** 2


def similarity(a, b):
    """Structural similarity of every pixel of two stacks of images of one size, at least a window large."""
    c1, c2, unbiased = (K1 * RANGE) ** 2, (K2 * RANGE) ** 2, WINDOW ** 2 / (WINDOW ** 2 - 1)
    ma, mb = means(a), means(b)
    va, vb = unbiased * (means(a * a) - ma * ma), unbiased * (means(b * b) - mb * mb)
    cov = unbiased * (means(a * b) - ma * mb)
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def split_value(levels):
    """For each row of 256 counts, the gray value that parts dark from bright with the greatest variance between both; 0 for one value."""
    n = levels.sum(1, keepdims=True)
    dark = levels.cumsum(1)
    weight = (levels * np.arange(256)).cumsum(1)
    with np.errstate(all="ignore"):
        apart = (weight * n - weight[:, -1:] * dark) ** 2 / (dark * (n - dark).astype(float))
    return np.where(np.isfinite(apart), apart, 0).argmax(1)


def changed(scores):
    """The pixels of a stack of similarity maps that are on the dark side of their map."""
    shades = (np.trunc(scores * 255).astype(np.int64) & 255).reshape(len(scores), -1)
    at = shades + 256 * np.arange(len(scores))[:, None]
    limit = split_value(np.bincount(at.ravel(), minlength=256 * len(scores)).reshape(-1, 256))
    return (shades <= limit[:, None]).reshape(scores.shape)


def _compare(a, b, threshold):
    """Rows of DIFF_SCHEMA for two stacks of images of one size."""
    differ, half = a != b, WINDOW // 2
    if min(a.shape[1:]) < WINDOW:  # too small for a window: equal or not
        score, regions = np.where(differ.any((1, 2)), 0.0, 1.0), outer_regions(differ, NOISE)
    else:
        scores = similarity(a, b)
        inner = scores[:, half:scores.shape[1] - half, half:scores.shape[2] - half]
        score, regions = inner.reshape(len(a), -1).mean(1), outer_regions(changed(scores), NOISE)
    for s, n, found in zip(score.tolist(), differ.sum((1, 2)).tolist(), regions):
        yield round(s, 4), n, s >= threshold, sum(int(r["area"]) for r in found), found


def image_diff(pairs, keys=("name",), threshold=PASS_SCORE):
    """Similarity, differing pixels, verdict and changed regions of every pair; the target is resized to the baseline.

    `regions` are the connected areas (diagonal neighbours count) of the pixels
    whose similarity is low, split off at the value that parts the map best.
    Holes belong to the region around them. Areas are those of the outline
    through the pixels' centres; regions of NOISE or less are left out.
    `changed_area` is the sum of the rest in whole pixels.
    """
    keys = list(keys)

    def diff(batches):
        for batch in batches:
            rows, sizes = [None] * len(batch), {}
            images = []
            for i, (base, other) in enumerate(zip(batch["baseline"], batch["target"])):
                a = gray(base)
                images.append((a, resize(gray(other), a.shape)))
                sizes.setdefault(a.shape, []).append(i)
            for shape, members in sizes.items():
                step = max(TOGETHER // max(shape[0] * shape[1], 1), 1)
                for at in range(0, len(members), step):
                    part = members[at:at + step]
                    a, b = (np.stack([images[i][side] for i in part]) for side in (0, 1))
                    for i, row in zip(part, _compare(a, b, threshold)):
                        rows[i] = row
            out = batch[keys].reset_index(drop=True)
            out[["ssim_score", "diff_pixels", "passed", "changed_area", "regions"]] = pd.DataFrame(rows, columns=range(5))
            yield out

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.mapInPandas(diff, f"{schema}, {DIFF_SCHEMA}")
