"""Words and hashes of Arrow text columns, many documents at once in numpy.

Text is handled as UTF-8 bytes. A-Z are lower-cased and the six ASCII white
space characters part words, so bytes and code points give the same words.
"""

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Fixed odd multipliers of the hashes.
ROOT = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x):
    """A bijection on 64-bit integers whose bits look random."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def raw(column):
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column, limit=CHUNK):
    """(first row, bytes, offsets) of runs of whole rows of about `limit` bytes."""
    data, offsets = raw(column)
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def powers(n):
    """1, r, r^2, ... modulo 2^64."""
    out = np.full(n, ROOT, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


INVERSE = np.uint64(pow(int(ROOT), -1, 1 << 64))


def inverse_powers(n):
    out = np.full(n, INVERSE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_bounds(data, offsets):
    """(first, end) bytes of each word."""
    n = len(data)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data, offsets, bounds=None):
    """(hash of each word, offsets of the rows in them) of lower-cased text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = bounds or word_bounds(data, offsets)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse_powers(n)[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def fold(hashes, width):
    """Hash of each run of `width` neighbours, at its first place (len - width + 1 of them)."""
    n = max(len(hashes) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * ROOT + hashes[i:i + n])
    return out


def shingles(data, offsets, width=5):
    """(hash of each run of `width` words, row offsets): shorter rows are one shingle, rows without words none."""
    word, bounds = words(data, offsets)
    count = np.diff(bounds)
    runs = fold(word, width)
    sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    if len(out):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(out)) - at[owner] + bounds[owner]
        long = (count >= width)[owner]
        out[long] = runs[place[long]]
        for row in np.flatnonzero((count > 0) & (count < width)):
            h = np.array([count[row]], np.uint64)
            for i in range(bounds[row], bounds[row + 1]):
                h = mix(h * ROOT + word[i:i + 1])
            out[at[row]] = h[0]
    return out, at
