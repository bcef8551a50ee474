"""Packing of token sequences: bounded-space online best fit, task by task.

Each task encodes its documents and keeps a fixed number of windows open. A document's full
windows are sequences at once; its rest goes to the open window it leaves the least room in.
If it fits in none, the fullest window is filled with the rest's head and emitted. What is
open when a task ends is a small table of its own, written like the rest, whose windows a
few more tasks place into one another in the same way. Their last rest is cut into powers
of two, which need no padding.

Windows hold tokens only while they are open, so a task's memory is one block of texts and
`open_windows * window` tokens.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, scratch_path
from curbside.llm.tokens import Encoder

__all__ = ["Packer", "pack_documents", "word_starts"]

WINDOW = 2048
OPEN_WINDOWS = 64
#: Tokens of open windows that one merging task gets, about.
MERGED = 4 << 20
#: Words that the library gets as one text.
_TOGETHER = 256
#: Tokens of a batch handed to Spark, about.
_BATCH = 1 << 20

_SPACE, _LETTER, _DIGIT, _MARK, _HIGH = range(5)
_KINDS = np.full(256, _MARK, dtype=np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x80:] = _HIGH


def word_starts(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that a word-end BPE encodes each on its own.

    Its pre-tokenizer drops white space and takes runs of letters, single digits, runs of
    other characters, and an apostrophe with certain letters behind it. Cuts are made here
    between ASCII characters alone, where no normal form or lower case reaches across.
    """
    kind = _KINDS[data]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    first = limits[:-1][np.diff(limits) > 0]
    before[first] = _SPACE
    quote = np.zeros(len(data), dtype=bool)
    quote[1:] = data[:-1] == 0x27
    solid = kind != _SPACE
    cut = (before == _SPACE) | (kind == _DIGIT) & (before != _HIGH)
    cut |= (before == _DIGIT) & (kind != _HIGH)
    cut |= (before == _LETTER) & (kind == _MARK)
    cut |= (before == _MARK) & ~quote & (kind == _LETTER)
    start = np.flatnonzero(cut & solid)
    ends = cut | ~solid
    stop = np.flatnonzero(ends)
    at = np.searchsorted(stop, start, side="right")
    return start, np.append(stop, len(data))[at]


class WordEncoder(Encoder):
    """Whole-text encoding that remembers words, for files whose parts all say that words
    are encoded one by one; texts that spell an added token go to the library whole, as do
    all texts with any other file."""

    def __init__(self, path: str):
        super().__init__(path, special=True)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        # The pattern of this kind of file.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_piece = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": pattern}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
        )
        # A short rare word that is one id, to stand between others encoded together.
        vocabulary = self.tokenizer.get_vocab() if self.by_piece else {}
        short = [w for w in vocabulary if len(w) == 7 and w.endswith("</w>")]
        plain = (w[:-4] for w in sorted(short, key=vocabulary.get, reverse=True))
        for word in (w for w in plain if w.isascii() and w.isalpha()):
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            if len(found) == 1:
                self.between, self.mark = f" {word} ", found[0]
                break
        else:
            self.by_piece = False

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `_ids`, many words to a text: each text costs the library as much as a word."""
        groups = [words[at : at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        flat, sizes = self._ids([self.between.join(group) for group in groups])
        ends = np.cumsum(sizes)
        ids, lengths = [], []
        for group, a, b in zip(groups, ends - sizes, ends, strict=True):
            mine = flat[a:b]
            real = mine != self.mark
            marks = np.flatnonzero(~real)
            if len(marks) == len(group) - 1:
                limits = np.concatenate([[-1], marks, [len(mine)]])
                ids.append(mine[real])
                lengths.append(np.diff(limits) - 1)
            else:  # one of the words has the mark itself
                for found, target in zip(self._ids(group), (ids, lengths), strict=True):
                    target.append(found)
        none = np.empty(0, dtype=np.int32)
        return np.concatenate([none, *ids]), np.concatenate([none.astype(np.int64), *lengths])

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, limits = tb.text_bytes(texts)
        start, end = word_starts(data, limits)
        hashes = tb.run_hashes(data, start, end)
        keys, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.memo.trim()
        new = self.memo.missing(keys)
        raw, at = data.tobytes(), sample[new]
        some = [
            raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)
        ]
        ids, lengths = self._apart(some)
        self.memo.add(keys[new], lengths, ids)
        ids, lengths = self.memo.gather(self.memo.places(keys)[kind])
        return ids, np.append(0, np.cumsum(lengths))[np.searchsorted(start, limits)]


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


#: A stretch of one document: id, first token, tokens, size of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Open windows of one task. Emitted pieces are in `out` as rows (piece, sequence,
    offset) until `take` is called."""

    def __init__(self, window: int = WINDOW, places: int = OPEN_WINDOWS, base: int = 0):
        if window < 1 or places < 1:
            raise ValueError("a window and an open place at least are wanted")
        self.window, self.places, self.next = window, places, base
        self.room: list[tuple[int, int]] = []  # (free tokens, window), fullest first
        self.held: dict[int, list[Piece]] = {}
        self.out: list[tuple[Piece, int, int]] = []
        self.size = 0

    def _emit(self, pieces: list[Piece], sequence: int | None = None) -> None:
        if sequence is None:
            sequence, self.next = self.next, self.next + 1
        offset = 0
        for piece in pieces:
            self.out.append((piece, sequence, offset))
            offset += len(piece[2])
        self.size += offset

    def _put(self, at: int, pieces: list[Piece], size: int) -> None:
        room, name = self.room.pop(at)
        self.held[name] += pieces
        if size < room:
            insort(self.room, (room - size, name))
        else:
            self._emit(self.held.pop(name), name)

    def add(self, pieces: list[Piece]) -> None:
        """Place pieces that shall stay together where they can."""
        size = sum(len(p[2]) for p in pieces)
        while size >= self.window:
            head, pieces = split(pieces, self.window)
            self._emit(head)
            size -= self.window
        while size:
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                return self._put(at, pieces, size)
            if len(self.room) < self.places:
                name, self.next = self.next, self.next + 1
                self.held[name] = [(d, s, ids.copy(), n) for d, s, ids, n in pieces]
                return insort(self.room, (self.window - size, name))
            fill = self.room[0][0]
            head, pieces = split(pieces, fill)
            self._put(0, head, fill)
            size -= fill

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first; they are no longer held."""
        left = [self.held.pop(name) for _, name in self.room]
        self.room = []
        return left

    def finish(self) -> None:
        """Emit what is open: full windows, then powers of two, biggest first."""
        pieces = [piece for window in self.rest() for piece in window]
        size = sum(len(p[2]) for p in pieces)
        while size:
            length = self.window if size >= self.window else 1 << (size.bit_length() - 1)
            head, pieces = split(pieces, length)
            self._emit(head)
            size -= length

    def take(self) -> list[tuple[Piece, int, int]]:
        out, self.out, self.size = self.out, [], 0
        return out


def split(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first `size` tokens, and those behind them."""
    head: list[Piece] = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) >= size:
            head.append((doc, start, ids[:size], total))
            tail = [(doc, start + size, ids[size:], total)] if len(ids) > size else []
            return head, tail + pieces[i + 1 :]
        head.append(pieces[i])
        size -= len(ids)
    return head, []


_FIELDS = "doc_id bigint, start bigint, length bigint, tokens array<int>, ids_crc32 bigint, " \
    "doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple[Piece, int, int]], still_open: bool | None) -> pa.RecordBatch:
    ids = [piece[2] for piece, _, _ in rows]
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    limits = np.append(0, np.cumsum(lengths)).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32, copy=False)
    raw = memoryview(flat.astype("<u4", copy=False).tobytes())
    at = (limits * 4).tolist()
    columns = {
        "doc_id": pa.array([p[0] for p, _, _ in rows], pa.int64()),
        "start": pa.array([p[1] for p, _, _ in rows], pa.int64()),
        "length": pa.array(lengths),
        "tokens": pa.ListArray.from_arrays(pa.array(limits), pa.array(flat)),
        "ids_crc32": pa.array(
            [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()
        ),
        "doc_tokens": pa.array([p[3] for p, _, _ in rows], pa.int64()),
        "sequence_id": pa.array([s for _, s, _ in rows], pa.int64()),
        "offset": pa.array([o for _, _, o in rows], pa.int64()),
    }
    if still_open is not None:
        columns["open"] = pa.array([still_open] * len(rows))
    return pa.RecordBatch.from_pydict(columns)


def _pack(path: str, end: int | None, window: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        packer = Packer(window, places, TaskContext.get().partitionId() << 40)
        for block in tb.blocks(batches):
            ids, limits = encode(block.column("text"))
            if end is not None:
                ids = np.insert(ids, limits[1:], end)
                limits = limits + np.arange(len(limits))
            names, at = block.column("doc_id").to_pylist(), limits.tolist()
            for doc, a, b in zip(names, at[:-1], at[1:], strict=True):
                packer.add([(doc, 0, ids[a:b], b - a)])
                if packer.size > _BATCH:
                    yield _batch(packer.take(), False)
            if packer.out:
                yield _batch(packer.take(), False)
        for pieces in packer.rest():
            packer._emit(pieces)
        if packer.out:
            yield _batch(packer.take(), True)

    return run


def _merge(window: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Negative numbers: those of the first tasks aren't.
        packer = Packer(window, places, -1 - TaskContext.get().partitionId() << 40)
        name, pieces = None, []
        for batch in batches:
            tokens = batch.column("tokens")
            limits, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            rows = zip(
                *(batch.column(c).to_pylist()
                  for c in ("sequence_id", "doc_id", "start", "doc_tokens")), strict=True
            )
            for i, (sequence, doc, start, total) in enumerate(rows):
                if sequence != name and pieces:
                    packer.add(pieces)
                    pieces = []
                name = sequence
                pieces.append((doc, start, flat[limits[i] : limits[i + 1]].copy(), total))
            if packer.out:
                yield _batch(packer.take(), None)
        packer.add(pieces)
        packer.finish()
        if packer.out:
            yield _batch(packer.take(), None)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int | None = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode whole texts, append `end` to each, and pack all tokens into sequences.

    One row per piece: doc_id, start (tokens of its document before it), length, tokens,
    ids_crc32 (of the tokens as little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset (in its sequence, without gaps). Sequences are `window` tokens long, but for the
    last of each merging task, whose lengths are powers of two.

    Null and empty texts have the end id only (and no piece without one). Rows that repeat
    an id, a null one too, are packed each. A longer document than a window is cut, a
    shorter one only where it fills a window. An empty table gives none. Nothing but key and
    text is read, so other names can't clash. Numbers of sequences follow the tasks; a task
    that runs again gives the same.
    """
    path = scratch_path(docs.sparkSession, "packed")
    placed = documents(docs, key, text).mapInArrow(
        _pack(tokenizer, end, window, open_windows), f"{_FIELDS}, open boolean"
    )
    placed.write.partitionBy("open").parquet(path)
    table = docs.sparkSession.read.schema(placed.schema).parquet(path)
    left = table.filter("open").drop("open")
    size = left.agg(F.sum("length")).first()[0] or 0
    merged = (
        left.repartition(max(1, -(-size // MERGED)), "sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
        .mapInArrow(_merge(window, open_windows), _FIELDS)
    )
    return table.filter("not open").drop("open").unionByName(merged)
