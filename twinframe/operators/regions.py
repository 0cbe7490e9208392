"""Connected regions of stacks of masks, by their runs: all images of a stack are labelled at once."""

import numpy as np


def runs_of(mask):
    """(image, row, first column, column after the last) of all runs of a stack of masks, in order."""
    edges = np.diff(np.pad(mask, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
    image, row, start = np.nonzero(edges == 1)
    return image, row, start, np.nonzero(edges == -1)[2]


def label_runs(mask, diagonal):
    """The runs of a stack of masks and the label of each: the number of the first run of its region."""
    image, row, start, end = runs_of(mask)
    line, width, reach = image * (mask.shape[1] + 1) + row, mask.shape[2] + 4, int(diagonal)
    # the runs of the next line that touch a run stand next to each other
    low = np.searchsorted(line * width + end, (line + 1) * width + start - reach, "right")
    high = np.searchsorted(line * width + start, (line + 1) * width + end + reach, "left")
    touching = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(line)), touching)
    b = np.arange(len(a)) - np.repeat(touching.cumsum() - touching, touching) + np.repeat(low, touching)
    label = np.arange(len(line))
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return image, row, start, end, label
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label = label[label]


def painted(shape, image, row, start, end, values, empty):
    """A stack with `values` of the runs, `empty` elsewhere."""
    out = np.full(shape, empty)
    length = end - start
    first = (image * shape[1] + row) * shape[2] + start
    at = np.repeat(first - (length.cumsum() - length), length) + np.arange(length.sum())
    out.ravel()[at] = np.repeat(np.broadcast_to(values, length.shape), length)
    return out


def without_holes(mask):
    """A stack of masks in which everything is set that cannot be reached from outside by straight steps."""
    outside = ~np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    image, row, start, end, label = label_runs(outside, False)
    first = np.full(len(mask), -1)
    first[image[row == 0]] = label[row == 0]  # the frame around each image
    reached = label == first[image]
    free = painted(outside.shape, *(x[reached] for x in (image, row, start, end)), True, False)
    return ~free[:, 1:-1, 1:-1]


def outer_regions(mask, noise=0):
    """For each mask of a stack its outermost regions of more than `noise` area, as dicts of x, y, width, height, area, from the top and left.

    The area is that within the outline through the centres of the border's
    pixels: of four neighbouring centres all four enclose one pixel, three half.
    """
    full = without_holes(mask)
    image, row, start, end, label = label_runs(full, True)
    wide = np.pad(painted(full.shape, image, row, start, end, label, -1), ((0, 0), (0, 1), (0, 1)), constant_values=-1)
    corners = np.stack([wide[:, :-1, :-1], wide[:, 1:, :-1], wide[:, :-1, 1:], wide[:, 1:, 1:]])
    cells = (corners >= 0).sum(0)
    inside = cells >= 3
    area = np.bincount(corners.max(0)[inside], weights=(cells[inside] - 2) / 2, minlength=len(label))
    top, left, bottom, right = (np.full(len(label), x) for x in (1 << 30, 1 << 30, 0, 0))
    for ends, ufunc, values in ((top, np.minimum, row), (left, np.minimum, start), (bottom, np.maximum, row + 1), (right, np.maximum, end)):
        ufunc.at(ends, label, values)
    out = [[] for _ in mask]
    for i in np.flatnonzero((label == np.arange(len(label))) & (area > noise)).tolist():
        out[image[i]].append({"x": int(left[i]), "y": int(top[i]), "width": int(right[i] - left[i]),
                              "height": int(bottom[i] - top[i]), "area": float(area[i])})
    return [sorted(found, key=lambda r: (r["y"], r["x"], r["height"], r["width"], r["area"])) for found in out]
