"""A cuckoo filter of digests that keeps its keys, so that it can verify hits, delete and grow."""

from array import array

#: Fixed values of the filter: slots a bucket, bytes a digest, moves before it grows.
SLOTS, WIDTH, KICKS = 4, 32, 200


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; every digest has two buckets it may be in.

    A key's second bucket follows from the first and the fingerprint, so entries
    move between their two buckets by fingerprint alone. `keys` holds the digest
    of each slot: a fingerprint that fits is a hit only if the digest is equal.
    """

    def __init__(self, n_buckets=1, prints=b"", keys=b""):
        """A filter, empty or as `stored` gave it."""
        assert n_buckets & (n_buckets - 1) == 0
        self.n_buckets = n_buckets
        self.prints = array("H", prints) if prints else array("H", bytes(2 * SLOTS * n_buckets))
        self.keys, at = [None] * len(self.prints), 0
        for slot, mark in enumerate(self.prints):
            if mark:
                self.keys[slot], at = keys[at:at + WIDTH], at + WIDTH

    def stored(self):
        """(n_buckets, prints, keys): the keys are those of the full slots, in order."""
        return self.n_buckets, self.prints.tobytes(), b"".join(k for k in self.keys if k is not None)

    def __len__(self):
        return len(self.keys) - self.keys.count(None)

    def _places(self, key):
        mark = int.from_bytes(key[8:10], "big") or 1
        bucket = int.from_bytes(key[:8], "big") & (self.n_buckets - 1)
        return mark, bucket, self._other(bucket, mark)

    def _other(self, bucket, mark):
        return bucket ^ (mark * 0x5BD1E995 >> 7 & (self.n_buckets - 1))

    def find(self, key):
        """The slot that holds the key, or -1."""
        mark, *buckets = self._places(key)
        for bucket in buckets:
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def _put(self, bucket, mark, key):
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.keys[slot] = mark, key
                return True
        return False

    def insert(self, key):
        """Add a key that is not there yet; a filter that overflows grows first."""
        mark, bucket, other = self._places(key)
        if self._put(bucket, mark, key) or self._put(other, mark, key):
            return
        for kick in range(KICKS):
            slot = other * SLOTS + (kick + mark) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.keys[slot], key = key, self.keys[slot]
            other = self._other(other, mark)
            if self._put(other, mark, key):
                return
        self._grow(key)

    def _grow(self, homeless):
        keys = [k for k in self.keys if k is not None] + [homeless]
        self.__init__(2 * self.n_buckets)
        for key in keys:
            self.insert(key)

    def delete(self, key):
        """Take a key out; tells whether it was there."""
        slot = self.find(key)
        if slot >= 0:
            self.prints[slot], self.keys[slot] = 0, None
        return slot >= 0
