"""Static range asymmetric numeral system on numpy arrays, many lanes at a time.

One frequency table serves all blocks. Neighbouring ids go to neighbouring
lanes of a block, every lane keeps a state of its own, and all lanes share one
stream of 32-bit words. A block decodes without any other.
"""

import zlib

import numpy as np

BITS, LOW = 20, np.uint64(1 << 31)
MASK = np.uint64((1 << BITS) - 1)
WORD, HALF = np.uint64(32), np.uint64((1 << 32) - 1)


class Table:
    """Frequencies, scaled to 2^BITS, of the ids that occur."""

    def __init__(self, ids, counts):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids, np.uint32)[order], np.asarray(counts, np.float64)[order]
        if len(self.ids) > 1 << (BITS - 1):
            raise ValueError("too many different ids for the frequency table")
        scaled = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << BITS))).astype(np.int64)
        while len(scaled) and (over := int(scaled.sum()) - (1 << BITS)):
            if over < 0:
                scaled[np.argmax(scaled)] -= over
            else:  # take from the largest, at most half of each
                for i in np.argsort(-scaled, kind="stable")[:max(1, min(over, len(scaled) // 4))]:
                    cut = min(over, int(scaled[i]) // 2)
                    scaled[i], over = scaled[i] - cut, over - cut
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64) if len(scaled) else self.freq

    def slots(self):
        return np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))


def lanes_for(n):
    """A power of two up to 1024 that gives each lane some 256 ids."""
    return 1 << min(10, max(0, (n // 256).bit_length() - 1))


def encode(ids, table):
    """(lanes, lane states, words) as (int, bytes, bytes)."""
    n, lanes = len(ids), lanes_for(len(ids))
    symbol = np.searchsorted(table.ids, ids)
    steps = -(-n // lanes)
    freq, start = (np.ones(steps * lanes, np.uint64) for _ in range(2))
    freq[:n], start[:n] = table.freq[symbol], table.start[symbol]
    freq, start = freq.reshape(steps, lanes), start.reshape(steps, lanes)
    limit = freq << np.uint64(31 - BITS + 32)
    state, out = np.full(lanes, LOW, np.uint64), []
    for t in range(steps - 1, -1, -1):
        k = min(lanes, n - t * lanes)
        x, f = state[:k], freq[t, :k]
        full = x >= limit[t, :k]
        out.append((x[full] & HALF).astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        div = x // f
        state[:k] = (div << np.uint64(BITS)) + (x - div * f) + start[t, :k]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return lanes, state.astype("<u8").tobytes(), words.astype("<u4").tobytes()


def decode(n, lanes, states, words, table, slots):
    """The n ids of a block as uint32."""
    state, words = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4").astype(np.uint64)
    steps, at = -(-n // lanes), 0
    symbol = np.zeros(steps * lanes, np.int64)
    for t in range(steps):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & MASK
        s = slots[slot]
        symbol[t * lanes:t * lanes + k] = s
        x = table.freq[s] * (x >> np.uint64(BITS)) + slot - table.start[s]
        few = np.flatnonzero(x < LOW)
        x[few] = (x[few] << WORD) | words[at:at + len(few)]
        at += len(few)
        state[:k] = x
    if at != len(words) or not (state == LOW).all():
        raise ValueError("the block does not end where it should")
    return table.ids[symbol[:n]]


def checksum(ids):
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
