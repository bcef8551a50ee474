"""Removal of passages that an earlier document already has.

Every window of `width` words gets a Rabin-Karp hash. Spark deals the hashes out by range,
and a range's task finds each hash's smallest document. What crosses the network are packed
columns, not a row per window, so the counting itself is numpy's, inside a range:

1. A task hashes the windows of its documents in chunks. Inside a chunk, windows that
   an earlier document of the chunk has are decided at once, so a passage sends one
   entry for each chunk, however many documents hold it. The rest goes out in hash
   ranges, as byte planes sorted by hash.
2. A task per hash range sorts its entries and answers with those whose hash also
   occurs in a smaller document.
3. Answers meet the texts again by document; windows merge into maximal intervals.

Hashes have 64 bits: of n windows, about n^2 / 2^65 pairs of different ones are taken
as equal (none to be expected in a corpus of a billion windows).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, pack, parts, row_key, unpack

#: Windows a task sorts at a time.
CHUNK = 1 << 21

_PARTS = "bucket int, grp int, data binary"
_RESULT = (
    "doc_id bigint, n_words bigint, n_removed bigint, "
    "spans array<struct<start: bigint, end: bigint>>, kept_text string"
)


def _frame(columns: list[bytes]) -> bytes:
    return struct.pack(f"<{len(columns)}q", *map(len, columns)) + b"".join(columns)


def _unframe(data: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}q", data)
    at, out = 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _send(hashes, doc, pos, ids, versions) -> bytes:
    """Entries sorted by hash; documents as places in a table of those that occur."""
    used, place = np.unique(doc, return_inverse=True)
    deltas = np.diff(hashes, prepend=np.uint64(0))
    columns = (deltas, place.astype(np.uint32), pos.astype(np.uint32), ids[used], versions[used])
    return _frame([pack(x) for x in columns])


def _receive(data: bytes):
    deltas, place, pos, ids, versions = (
        unpack(x, t)
        for x, t in zip(
            _unframe(data, 5), (np.uint64, np.uint32, np.uint32, np.int64, np.uint32), strict=True
        )
    )
    return np.cumsum(deltas, dtype=np.uint64), ids[place], versions[place], pos


def _answer(ids, versions, pos) -> bytes:
    order = np.lexsort((pos, versions, ids))
    ids = np.diff(ids[order], prepend=np.int64(0))
    return _frame([pack(ids), pack(versions[order]), pack(pos[order])])


def _answered(data: bytes):
    ids, versions, pos = (
        unpack(x, t)
        for x, t in zip(_unframe(data, 3), (np.int64, np.uint32, np.uint32), strict=True)
    )
    return np.cumsum(ids), versions, pos


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )


_PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("data", pa.binary())])


def _answers(ids, versions, pos, groups: int, bucket) -> Iterator[tuple]:
    """Rows (bucket, group, data), the documents dealt into their groups."""
    to = versions.astype(np.int64) % groups
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        group = int(to[part[0]])
        yield bucket(group), group, _answer(ids[part], versions[part], pos[part])


def _hash_windows(width: int, buckets: int, groups: int, chunk: int):
    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, doc, pos = (np.concatenate([x[i] for x in found]) for i in range(3))
        ids, versions = (np.concatenate([x[i] for x in found]) for i in (3, 4))
        if not len(hashes):
            return
        order = np.lexsort((ids[doc], hashes))
        hashes, doc, pos = hashes[order], doc[order], pos[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        smallest = ids[doc][new][np.cumsum(new) - 1]
        lost = ids[doc] > smallest
        rows = list(_answers(
            ids[doc[lost]], versions[doc[lost]], pos[lost], groups, lambda g: g % buckets
        ))
        hashes, doc, pos = hashes[~lost], doc[~lost], pos[~lost]
        edges = [((b << 32) // buckets) << 32 for b in range(1, buckets)]
        cuts = np.searchsorted(hashes, np.array(edges, dtype=np.uint64))
        for bucket, (lo, hi) in enumerate(
            zip(np.append(0, cuts), np.append(cuts, len(hashes)), strict=True)
        ):
            if hi > lo:
                data = _send(hashes[lo:hi], doc[lo:hi], pos[lo:hi], ids, versions)
                rows.append((bucket, -1, data))
        yield _batch(rows, _PARTS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, windows, docs = [], 0, 0
        for block in tb.blocks(batches):
            tokens = tb.tokenise(block.column("text"))
            starts, counts = tb.window_starts(tokens, width)
            doc = np.repeat(np.arange(len(tokens)), counts)
            found.append((
                tb.rolling(tokens.hashes, width)[starts],
                (doc + docs).astype(np.uint32),
                (starts - tokens.first[doc]).astype(np.uint32),
                block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64),
                block.column("version").to_numpy(zero_copy_only=False).astype(np.uint32),
            ))
            windows, docs = windows + len(starts), docs + len(tokens)
            if windows >= chunk:
                yield from flush(found)
                found, windows, docs = [], 0, 0
        if found:
            yield from flush(found)

    return run


def _find_repeats(groups: int):
    def solve(rows: list[bytes]) -> Iterator[tuple]:
        hashes, ids, versions, pos = map(
            np.concatenate, zip(*(_receive(x) for x in rows), strict=True)
        )
        order = np.lexsort((ids, hashes))
        hashes, ids, versions, pos = hashes[order], ids[order], versions[order], pos[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        lost = ids > ids[new][np.cumsum(new) - 1]
        yield from _answers(ids[lost], versions[lost], pos[lost], groups, lambda g: 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for bucket, group, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group >= 0:  # decided already
                    yield _batch([(0, group, data)], _PARTS_ARROW)
                    continue
                if bucket != current and held:
                    if rows := list(solve(held)):
                        yield _batch(rows, _PARTS_ARROW)
                    held = []
                current = bucket
                held.append(data)
        if held and (rows := list(solve(held))):
            yield _batch(rows, _PARTS_ARROW)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(block: pa.RecordBatch, lost, width: int) -> pa.RecordBatch:
    """Result rows of a block of documents. `lost`: sorted keys and positions."""
    keys, at = lost
    tokens = tb.tokenise(block.column("text"))
    n = len(tokens.start)
    ids = block.column("doc_id").to_pylist()
    versions = block.column("version").to_pylist()
    cover = np.zeros(n + width + 1, dtype=np.int64)
    for i, key in enumerate(zip(ids, versions, strict=True)):
        lo, hi = keys.get(key, (0, 0)) if key[0] is not None else (0, 0)
        starts = at[lo:hi].astype(np.int64) + tokens.first[i]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + width, -1)
    gone = np.cumsum(cover)[:n] > 0
    owner = np.repeat(np.arange(len(tokens)), tokens.counts)
    removed = np.bincount(owner[gone], minlength=len(tokens))

    edge = np.empty(n, dtype=bool)  # a new interval begins
    if n:
        edge[0] = True
        edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], n)
    begin, stop = begin[gone[begin]], stop[gone[begin]]
    base = tokens.first[owner[begin]]
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - base), pa.array(stop - base)], names=["start", "end"]
    )
    span_limits = np.searchsorted(owner[begin], np.arange(len(tokens) + 1))

    kept = ~gone
    start, length = tokens.start[kept], (tokens.end - tokens.start)[kept] + 1
    letters = np.append(tokens.data, np.uint8(0x20))[tb.ranges(start, length)]
    ends = np.cumsum(length)
    letters[ends - 1] = 0x20
    words = np.bincount(owner[kept], minlength=len(tokens))
    limits = np.append(0, ends)[np.append(0, np.cumsum(words))]
    text = [
        bytes(letters[a : max(a, b - 1)])
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)
    ]
    return pa.record_batch({
        "doc_id": block.column("doc_id"),
        "n_words": pa.array(tokens.counts),
        "n_removed": pa.array(removed),
        "spans": pa.ListArray.from_arrays(pa.array(span_limits, pa.int32()), spans).cast(_SPANS),
        "kept_text": pa.array(text, pa.binary()).cast(pa.string()),
    })


def _remove(width: int):
    def gather(answers: list[bytes]):
        if not answers:
            return {}, np.empty(0, np.uint32)
        ids, versions, pos = map(np.concatenate, zip(*map(_answered, answers), strict=True))
        order = np.lexsort((pos, versions, ids))
        ids, versions, pos = ids[order], versions[order], pos[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(ids))
        keys = zip(ids[begin].tolist(), versions[begin].tolist(), strict=True)
        return dict(zip(keys, zip(begin.tolist(), stop.tolist(), strict=True), strict=True)), pos

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, answers, lost = None, [], None
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            is_text = batch.column("is_text").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(is_text.astype(int)) != 0))
            for lo, hi in zip(
                np.append(0, edges + 1), np.append(edges + 1, len(groups)), strict=True
            ):
                part = batch.slice(lo, hi - lo)
                if groups[lo] != group:
                    group, answers, lost = groups[lo], [], None
                if not is_text[lo]:
                    answers += part.column("data").to_pylist()
                    continue
                if lost is None:
                    lost, answers = gather(answers), []
                for block in tb.blocks(iter([part])):
                    yield _cut(block, lost, width)

    return run


def remove_repeated_passages(
    docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, spans (maximal intervals of removed words,
    end exclusive) and kept_text (the kept words joined by one space).

    A word goes if a window of `width` words covering it also starts in a document with
    a smaller id; windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`.
    Null and empty texts have no words and an empty kept_text. A text of fewer than
    `width` words keeps them all. Rows that repeat an id don't take from each other;
    each row is returned. Rows with a null id are returned whole and take nothing from
    others. Other columns of `docs` are not looked at.
    """
    base = documents(docs, key, text)
    version = F.col("key").bitwiseAND(0xFFFFFFFF).alias("version")
    rows = base.withColumn("key", row_key()).select("doc_id", version, "text")
    n = parts(base)
    hashed = (
        rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(_hash_windows(width, n, n, chunk), _PARTS)
        .repartitionById(n, "bucket")  # a range each: a hash of n numbers would double some
        .sortWithinPartitions("bucket")
    )
    answers = hashed.mapInArrow(_find_repeats(n), _PARTS).select(
        "grp", F.lit(False).alias("is_text"), F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("string").alias("text"),
        "data",
    )
    texts = rows.select(
        (F.col("version") % n).cast("int").alias("grp"), F.lit(True).alias("is_text"),
        "doc_id", "version", "text", F.lit(None).cast("binary").alias("data"),
    )
    return (
        answers.union(texts)
        .repartitionById(n, "grp")
        .sortWithinPartitions("grp", "is_text")
        .mapInArrow(_remove(width), _RESULT)
    )
