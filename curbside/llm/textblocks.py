"""Vectorised tokens and hashes over the bytes of whole Arrow text columns.

The token rules of the operators are byte classes (every byte of a multi-byte UTF-8
character has one class), so token limits, token hashes and n-gram hashes of a block
of texts are computed in numpy over the block's one byte buffer, without a Python
object per token. Blocks are cut by bytes: memory follows `block_bytes`, or the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: Odd multiplier of the polynomial hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

SEPARATOR, WORD, PUNCTUATION = 0, 1, 2


def byte_classes(separators: bytes, punctuation: bytes = b"") -> np.ndarray:
    """Class of each byte: separator, punctuation, or (all others) word."""
    classes = np.full(256, WORD, dtype=np.uint8)
    classes[list(separators)] = SEPARATOR
    if punctuation:
        classes[list(punctuation)] = PUNCTUATION
    return classes


#: Words are `[^\x20\x09-\x0D]+`.
SPACED = byte_classes(bytes([0x20, *range(0x09, 0x0E)]))


def letter_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if `lower`."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    values = values * np.uint64(2) + np.uint64(1)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


EXACT, LOWER = letter_values(False), letter_values(True)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


class _Tables:
    """Powers of the base, kept for the largest block so far."""

    up = _powers(_BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


@dataclass
class Tokens:
    """Tokens of a block of texts. Text `i` has tokens `first[i]:first[i + 1]`; token
    `j` is the bytes `start[j]:end[j]` of `data`."""

    data: np.ndarray
    limits: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def __len__(self) -> int:
        return len(self.first) - 1


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The block's bytes and the `n + 1` limits of its texts. Null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokenise(
    texts: pa.Array, classes: np.ndarray = SPACED, letters: np.ndarray = EXACT
) -> Tokens:
    """Maximal runs of bytes of one class, separators left out, with their hashes."""
    data, limits = text_bytes(texts)
    n = len(data)
    kind = classes[data]
    new = np.empty(n, dtype=bool)
    if n:
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        inner = limits[1:-1]
        new[inner[inner < n]] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    real = kind[runs] != SEPARATOR
    start, end = runs[real], ends[real]
    first = np.searchsorted(start, limits)
    return Tokens(data, limits, start, end, first, run_hashes(data, start, end, letters))


def run_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray = EXACT
) -> np.ndarray:
    """Hashes of the byte runs `start:end`: polynomials, got from one prefix sum."""
    n = len(data)
    up, down = _Tables.of(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(letters[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` consecutive values: the hash of a run
    is a polynomial in its values, got from two prefix sums. Runs cross text limits;
    `window_starts` has those that don't."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.uint64)
    up, down = _Tables.of(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    runs = (sums[width:] - sums[:-width]) * down[: len(hashes) - width + 1]
    return mix(runs + np.uint64((width * 0x632BE59BD9B4E019 + seed) & _MASK))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of `start .. start + length - 1`, one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(total)


def window_starts(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of every window of `width` tokens inside one text, and the number
    of such windows of each text."""
    counts = np.maximum(tokens.counts - width + 1, 0)
    return ranges(tokens.first[:-1], counts), counts


def blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; one longer text is a
    batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(total[at - 1]) if at else 0
            to = max(int(np.searchsorted(total, base + size, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def distinct_within(
    owner: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted. `owner` must be ascending."""
    if not len(values):
        return owner, values
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.empty(len(values), dtype=bool)
    new[0] = True
    np.logical_or(values[1:] != values[:-1], owner[1:] != owner[:-1], out=new[1:])
    return owner[new], values[new]
