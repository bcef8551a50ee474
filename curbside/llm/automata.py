"""Weighted acyclic automata over word sequences, as flat arrays.

A `Transducer` maps every prefix of the sequences it was built from to a count: the number
of sequences that begin with it. It is built in one sweep per depth over sequences that come
sorted, and states whose arcs agree in label, weight and target are one state.

Words are 64-bit keys. Sequences are rows of `width` ranks in the ascending list of keys, 0
standing for "no more words", so that rows sort as their keys do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from curbside.llm import textblocks as tb
from curbside.llm.common import pack, unpack


@dataclass
class Arcs:
    """Arcs of all states of one depth: state `s` has `first[s]:first[s + 1]`, by label."""

    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    def sums(self) -> np.ndarray:
        """Weight that leaves each state."""
        total = np.append(0, np.cumsum(self.weight))
        return total[self.first[1:]] - total[self.first[:-1]]


def nodes(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth, first and last + 1 row of every distinct prefix of that length."""
    n, width = rows.shape
    changed = np.zeros(n, dtype=bool)
    changed[:1] = True
    out = []
    for d in range(width):
        changed[1:] |= rows[1:, d] != rows[:-1, d]
        edges = np.flatnonzero(changed)
        real = rows[edges, d] != 0
        out.append((edges[real], np.append(edges[1:], n)[real]))
    return out


def _shared(first, counts, label, weight, target) -> tuple[np.ndarray, np.ndarray]:
    """A state for each node (0 without arcs), and the nodes whose arcs the states have."""
    some = np.flatnonzero(counts)
    state = np.zeros(len(counts), dtype=np.int32)
    if not len(some):
        return state, some
    odd = np.uint64(0x9E3779B97F4A7C15)
    mixed = tb.mix(weight.astype(np.uint64) * odd + target.astype(np.uint64))
    mixed = tb.mix(mixed * odd + label.astype(np.uint64))
    sums = np.add.reduceat(mixed, first[some])
    keys, sample, kind = np.unique(sums, return_index=True, return_inverse=True)
    like = some[sample[kind]]
    # Equal sums are a hint: only equal arcs make one state.
    same = counts[some] == counts[like]
    here = tb.ranges(first[some], counts[some])
    there = tb.ranges(np.where(same, first[like], first[some]), counts[some])
    differ = label[here] != label[there]
    differ |= (weight[here] != weight[there]) | (target[here] != target[there])
    same &= ~np.logical_or.reduceat(differ, np.cumsum(counts[some]) - counts[some])
    own = np.flatnonzero(~same)
    kind[own] = len(keys) + np.arange(len(own))
    state[some] = kind + 1
    return state, np.append(some[sample], some[own])


class Transducer:
    """Counts of prefixes. `keys[0]` is no word; depth 0 has the start state alone, state 0
    of every other depth has no arcs."""

    def __init__(self, keys: np.ndarray, levels: list[Arcs]):
        self.keys, self.levels = keys, levels

    @classmethod
    def build(cls, keys: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> Transducer:
        """From distinct sorted rows, each with the number of its sequences."""
        total = np.append(0, np.cumsum(weight))
        depths = nodes(rows)
        width = rows.shape[1]
        levels: list[Arcs] = []
        target = np.zeros(len(depths[-1][0]), dtype=np.int32)
        for d in range(width - 1, -1, -1):
            at, end = depths[d]
            label, sizes = rows[at, d], total[end] - total[at]
            if d:
                parent = np.searchsorted(depths[d - 1][0], at, side="right") - 1
                counts = np.bincount(parent, minlength=len(depths[d - 1][0]))
                first = np.cumsum(counts) - counts
                state, kept = _shared(first, counts, label, sizes, target)
                arcs = tb.ranges(first[kept], counts[kept])
                limits = np.concatenate([[0, 0], np.cumsum(counts[kept])])
                levels.append(Arcs(limits, label[arcs], sizes[arcs], target[arcs]))
                target = state
            else:
                levels.append(Arcs(np.array([0, len(at)]), label, sizes, target))
        return cls(keys, levels[::-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted rows and weights it was built from."""
        top = self.levels[0]
        label, weight, target = top.label, top.weight, top.target
        columns = [label]
        for arcs in self.levels[1:]:
            ended = weight - arcs.sums()[target]
            stops = (ended > 0).astype(np.int64)
            counts = np.diff(arcs.first)[target]
            new = counts + stops
            begin = np.cumsum(new) - new
            back = np.repeat(np.arange(len(new)), new)
            label = np.zeros(len(back), dtype=np.int32)
            next_weight = np.zeros(len(back), dtype=np.int64)
            next_target = np.zeros(len(back), dtype=np.int32)
            at = begin[stops > 0]
            next_weight[at] = ended[stops > 0]
            to, source = tb.ranges(begin + stops, counts), tb.ranges(arcs.first[target], counts)
            label[to], next_weight[to] = arcs.label[source], arcs.weight[source]
            next_target[to] = arcs.target[source]
            columns = [c[back] for c in columns] + [label]
            weight, target = next_weight, next_target
        return np.stack(columns, axis=1).reshape(-1, len(self.levels)), weight

    def compose(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Counts of whole sequences, 0 if it has none: the composition with the acceptor
        of `rows` (sorted, distinct, of ranks in `keys`). Pairs of states go down together,
        one for each distinct prefix of the rows."""
        rank = np.searchsorted(self.keys, keys)
        known = rank < len(self.keys)
        known[known] = self.keys[rank[known]] == keys[known]
        rank = np.where(known, rank, -1)
        out = np.zeros(len(rows), dtype=np.int64)
        above, state = None, None
        base = len(self.keys) + 1
        for d, (at, _) in enumerate(nodes(rows)):
            if not len(at):
                break
            arcs = self.levels[d]
            if d == 0:
                pair = np.zeros(len(at), dtype=np.int64)
            else:
                pair = state[np.searchsorted(above, at, side="right") - 1]
            owner = np.repeat(np.arange(len(arcs.first) - 1), np.diff(arcs.first))
            have = owner * base + arcs.label
            label = rank[rows[at, d]].astype(np.int64)
            want = np.where((pair < 0) | (label < 0), -1, pair * base + label)
            place = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            hit = have[place] == want if len(have) else np.zeros(len(at), dtype=bool)
            state, weight = np.full(len(at), -1, np.int64), np.zeros(len(at), dtype=np.int64)
            state[hit], weight[hit] = arcs.target[place[hit]], arcs.weight[place[hit]]
            last = np.ones(len(at), dtype=bool)
            if d + 1 < rows.shape[1]:  # rows that end here come first below their prefix
                last = rows[at, d + 1] == 0
            out[at[last]] = weight[last]
            above = at
        return out

    def encode(self) -> bytes:
        arrays = [self.keys]
        for arcs in self.levels:
            arrays += [np.diff(arcs.first), arcs.label, arcs.weight, arcs.target]
        blobs = [pack(_narrow(a)) for a in arrays]
        head = [len(self.levels)]
        for a, blob in zip(arrays, blobs, strict=True):
            head += [_narrow(a).itemsize, len(blob)]
        return np.array(head, dtype="<i8").tobytes() + b"".join(blobs)

    @classmethod
    def decode(cls, data: bytes) -> Transducer:
        width = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        fields = 1 + 4 * width
        head = np.frombuffer(data, dtype="<i8", count=1 + 2 * fields)[1:].reshape(-1, 2)
        at, arrays = 8 * (1 + 2 * fields), []
        for size, length in head.tolist():
            arrays.append(unpack(data[at : at + length], f"<u{size}"))
            at += length
        levels = []
        for d in range(width):
            counts, label, weight, target = arrays[1 + 4 * d :][:4]
            levels.append(Arcs(
                np.append(0, np.cumsum(counts, dtype=np.int64)), label.astype(np.int32),
                weight.astype(np.int64), target.astype(np.int32),
            ))
        return cls(arrays[0].astype(np.uint64), levels)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the fewest bytes of 1, 2, 4 and 8."""
    most = int(values.max()) if len(values) else 0
    for size in (1, 2, 4):
        if most < 1 << 8 * size:
            return values.astype(f"<u{size}")
    return values.astype("<u8")


def ranked(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of an array of keys (0 for none first), and its ranks in them."""
    keys, ranks = np.unique(windows, return_inverse=True)
    ranks = ranks.reshape(windows.shape)
    if not len(keys) or keys[0] != 0:
        keys, ranks = np.append(keys.dtype.type(0), keys), ranks + 1
    return keys, ranks.astype(np.int32)


def summed(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their weights."""
    order, new = _order(rows)
    at = np.flatnonzero(new)
    if not len(at):
        return rows, weight
    return rows[order[at]], np.add.reduceat(weight[order], at)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and which of them each row is."""
    order, new = _order(rows)
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[order[new]], which


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each occurs."""
    bits = _bits(rows)
    if bits * rows.shape[1] > 64:
        return summed(rows, np.ones(len(rows), dtype=np.int64))
    keys = _joined(rows, bits)
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    out, keys = np.empty((len(at), rows.shape[1]), dtype=rows.dtype), keys[at]
    for d in range(rows.shape[1] - 1, -1, -1):
        out[:, d] = keys & np.uint64((1 << bits) - 1)
        keys >>= np.uint64(bits)
    return out, np.diff(np.append(at, len(rows)))


def _bits(rows: np.ndarray) -> int:
    return max(1, int(rows.max()).bit_length()) if len(rows) else 1


def _joined(rows: np.ndarray, bits: int) -> np.ndarray:
    """Rows as one number each, in the same order; they must fit."""
    keys = np.zeros(len(rows), dtype=np.uint64)
    for d in range(rows.shape[1]):
        keys <<= np.uint64(bits)
        keys |= rows[:, d].astype(np.uint64)
    return keys


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order of the rows, and which of the rows in that order are new."""
    bits, width = _bits(rows), rows.shape[1]
    fit = 64 // bits  # columns to a number
    keys = [_joined(rows[:, d : d + fit], bits) for d in range(0, width, fit)]
    if len(keys) == 1:
        order = np.argsort(keys[0], kind="stable")
    else:
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def merged(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sorted rows and weights of a union: weights of equal sequences added up."""
    keys = np.unique(np.concatenate([p.keys for p in parts]))
    rows, weights = [], []
    for part in parts:
        place = np.searchsorted(keys, part.keys).astype(np.int32)
        found, weight = part.rows()
        rows.append(place[found])
        weights.append(weight)
    return keys, *summed(np.concatenate(rows), np.concatenate(weights))


def union(parts: list[Transducer]) -> Transducer:
    return parts[0] if len(parts) == 1 else Transducer.build(*merged(parts))
