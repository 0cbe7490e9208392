import numpy as np
import pytest

from twinframe.operators import images
from twinframe.operators.regions import label_runs, outer_regions, painted, without_holes

STEPS4 = [(0, 1), (1, 0), (0, -1), (-1, 0)]
STEPS8 = STEPS4 + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def flood(mask, steps):
    """Regions of one mask as sets of pixels."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    while left:
        todo = [left.pop()]
        region = set(todo)
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    region.add((y + dy, x + dx))
                    todo.append((y + dy, x + dx))
        out.append(region)
    return out


def outline_area(region):
    """Area within the outer border of a region without holes, followed pixel by pixel."""
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from the left
    start = min(region)
    path, at, back = [start], start, 0
    while True:
        for k in range(1, 9):
            way = ring[(back + k) % 8]
            step = (at[0] + way[0], at[1] + way[1])
            if step in region:
                break
        else:
            return 0.0
        # look next from the pixel that was looked at last
        before = ring[(back + k - 1) % 8]
        seen = (at[0] + before[0] - step[0], at[1] + before[1] - step[1])
        at, back = step, ring.index(seen)
        path.append(at)
        if at == start and len(path) > 2 and (len(path) > 4 * len(region) + 8 or path[1] == _next(at, back, region, ring)):
            break
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, path[1:]))) / 2


def _next(at, back, region, ring):
    return next((at[0] + ring[(back + k) % 8][0], at[1] + ring[(back + k) % 8][1]) for k in range(1, 9)
                if (at[0] + ring[(back + k) % 8][0], at[1] + ring[(back + k) % 8][1]) in region)


def brute(mask, noise):
    wide = np.pad(~mask, 1, constant_values=True)
    outside = next(r for r in flood(wide, STEPS4) if (0, 0) in r)
    full = np.array([[(y + 1, x + 1) not in outside for x in range(mask.shape[1])] for y in range(mask.shape[0])], bool).reshape(mask.shape)
    out = []
    for region in flood(full, STEPS8):
        ys, xs = [p[0] for p in region], [p[1] for p in region]
        area = outline_area(region)
        if area > noise:
            out.append({"x": min(xs), "y": min(ys), "width": max(xs) - min(xs) + 1, "height": max(ys) - min(ys) + 1, "area": area})
    return sorted(out, key=lambda r: (r["y"], r["x"], r["height"], r["width"], r["area"]))


def drawn(*rows):
    return np.array([[c != "." for c in r] for r in rows])


SHAPES = {
    "empty": drawn("....", "....", "...."),
    "full": drawn("####", "####", "####"),
    "diagonal": drawn("##....", "##....", "..##..", "..##..", "....#.", "...#.."),
    "nested": drawn("#######", "#.....#", "#.###.#", "#.#.#.#", "#.###.#", "#.....#", "#######"),
    "border": drawn("##..##", "#....#", "......", "#....#", "##..##"),
    "open": drawn("#####", "#...#", "#.#.#", "#...#", "##.##"),
    "leaky corner": drawn(".###.", "#...#", "#.#.#", "#...#", ".###."),
    "lines": drawn("#####....", "........#", "#.#.#...#", ".#.#.#..#"),
    "one": drawn("#"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    assert outer_regions(SHAPES[name][None], 0) == [brute(SHAPES[name], 0)]


def test_random_masks_of_a_stack():
    rng = np.random.default_rng(7)
    for share in (0.1, 0.3, 0.5, 0.6, 0.8):
        masks = rng.random((25, 13, 17)) < share
        for noise in (0, 5):
            assert outer_regions(masks, noise) == [brute(m, noise) for m in masks]
        image, row, start, end, label = label_runs(masks, True)
        got = painted(masks.shape, image, row, start, end, label, -1)
        for k, m in enumerate(masks):
            assert sorted(map(sorted, flood(m, STEPS8))) == sorted(
                sorted((int(y), int(x)) for y, x in np.argwhere(got[k] == v)) for v in set(got[k][m].tolist()))


def test_a_long_winding_region():
    mask = np.zeros((1, 401, 401), bool)
    mask[0, ::2] = True
    mask[0, 1::4, -1] = mask[0, 3::4, 0] = True
    assert len(set(label_runs(mask, False)[4].tolist())) == 1
    assert without_holes(mask).sum() == mask.sum()


def test_split_value():
    counts = np.zeros((3, 256), int)
    counts[0, [10, 12, 200, 210]] = [50, 30, 5, 90]
    counts[1, 255] = 64
    counts[2, [0, 255]] = [3, 5]
    values = np.arange(256)
    def best(c):
        scores = []
        for t in values:
            a, b = c[:t + 1], c[t + 1:]
            if a.sum() and b.sum():
                ma, mb = (a * values[:t + 1]).sum() / a.sum(), (b * values[t + 1:]).sum() / b.sum()
                scores.append((a.sum() * b.sum() * (ma - mb) ** 2, -t))
        return -max(scores)[1] if scores else 0
    assert images.split_value(counts).tolist() == [best(c) for c in counts] == [12, 0, 0]


def test_changed_regions_of_images(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(90, 160, (60, 80)).astype(np.uint8)
    other = base.copy()
    other[10:30, 15:40] = 255 - other[10:30, 15:40]
    other[45:55, 60:75] = 0
    pairs = [("two", base, other), ("same", base, base), ("small", base[:5, :5], other[:5, :5])]
    rows = [(n, *(dict(height=x.shape[0], width=x.shape[1], channels=1, data=x.tobytes()) for x in (a, b))) for n, a, b in pairs]
    side = "struct<height:int,width:int,channels:int,data:binary>"
    got = {r.name: r for r in images.image_diff(spark.createDataFrame(rows, f"name string, baseline {side}, target {side}")).collect()}
    assert (got["same"].ssim_score, got["same"].changed_area, got["same"].regions) == (1.0, 0, [])
    assert got["small"].regions == [] and got["small"].passed
    boxes = [(r.x, r.y, r.width, r.height) for r in got["two"].regions]
    for x, y, w, h in ((15, 10, 25, 20), (60, 45, 15, 10)):  # a window around each change
        assert any(abs(a - x) <= 4 and abs(b - y) <= 4 and abs(c - w) <= 8 and abs(d - h) <= 8 for a, b, c, d in boxes)
    assert got["two"].changed_area == sum(int(r.area) for r in got["two"].regions) > 400
