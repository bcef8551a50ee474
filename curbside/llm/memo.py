"""Integer sequences remembered by 64-bit key, in flat arrays."""

from __future__ import annotations

import numpy as np

from curbside.llm import textblocks as tb


class Memo:
    """Sequences by key. Beyond `limit` keys it starts anew, so its memory is bounded."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.start = np.empty(0, dtype=np.int64)
        self.length = np.empty(0, dtype=np.int64)
        self.extra = np.empty(0, dtype=np.int64)
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.used = 0

    def trim(self) -> None:
        if len(self.keys) > self.limit:
            self.clear()

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of those of the distinct `keys` that aren't known."""
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def add(self, keys, lengths, flat, extra=None) -> None:
        """New distinct keys with their sequences, one after the other in `flat`."""
        if not len(keys):
            return
        lengths = np.asarray(lengths, dtype=np.int64)
        need = self.used + len(flat)
        if need > len(self.flat):
            grown = np.empty(max(need, 2 * len(self.flat)), dtype=np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : need] = flat
        start = self.used + np.cumsum(lengths) - lengths
        self.used = need
        extra = np.zeros(len(keys), dtype=np.int64) if extra is None else extra
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        for name, new in (("start", start), ("length", lengths), ("extra", extra)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        self.keys = np.insert(self.keys, at, keys[order])

    def places(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at `places`, one after the other, and their lengths."""
        lengths = self.length[places]
        return self.flat[tb.ranges(self.start[places], lengths)], lengths
