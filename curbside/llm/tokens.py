"""Token-ID output: texts as Parquet list columns, laid out for selective reads.

Files are in ascending id order with small row groups and page indexes. Token ids are
dictionary encoded (a vocabulary is a small dictionary, so an id takes as many bits as
the group's vocabulary needs); id, place and length columns are delta encoded. A reader
of lengths or places never touches the token pages, and a reader of some documents only
the pages that hold them.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, parts
from curbside.llm.memo import Memo

#: Pieces of text a worker remembers; beyond, it starts anew.
REMEMBERED = 600_000

#: Row groups and pages in bytes, and the encodings.
LAYOUT = {
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "place", "n_tokens", "part")},
    "compression": "zstd",
}


_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_DIGITS = np.isin(np.arange(256), range(0x30, 0x3A))
_MARKS = (np.arange(256) < 0x80) & ~_SPACES & ~_LETTERS & ~_DIGITS


def pieces(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Starts of pieces that byte-level BPE encodes each on its own.

    Its pre-tokenizer cuts between runs of letters, of digits, of white space and of
    other characters; the last white space before a run is cut off too, and a blank goes
    with the run. Cuts are made here only where bytes alone prove one, so a piece may be
    several of its tokens but never a part of one: apostrophes stay with the letters
    behind them, and characters beyond Latin with their neighbours.
    """
    n = len(data)
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]]) if n else data
    after = np.concatenate([data[1:], np.full(1, 0x80, np.uint8)]) if n else data
    ends = limits[1:][limits[1:] > 0] - 1
    after[ends] = 0x80  # nothing is known of what follows a text
    lead = np.concatenate([np.zeros(2, np.uint8), data[:-2]])[:n]
    latin = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((before | 0x20) == 0xB7))
    latin &= (before & 0xC0) == 0x80
    space, letter, digit, mark = (t[data] for t in (_SPACES, _LETTERS, _DIGITS, _MARKS))
    solid = (after < 0x80) & ~_SPACES[after]
    ended = latin | _LETTERS[before]
    cut = space & solid
    cut |= _SPACES[before] & (before != 0x20) & (letter | digit | mark)
    cut |= ended & (mark | digit | space)
    cut |= _DIGITS[before] & (letter | mark | space)
    cut |= _MARKS[before] & (((before != 0x27) & (letter | digit)) | space)
    cut[limits[:-1][np.diff(limits) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole-text encoding by a tokenizers file.

    With a plain byte-level pre-tokenizer equal pieces of text have equal ids, so a worker
    encodes each piece once and remembers it. Other tokenizers get whole texts, and so does
    any for texts that spell an added token. Unless `special`, special tokens are only text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        spec = json.loads(self.tokenizer.to_str())
        self.added = [
            t["content"] for t in spec.get("added_tokens") or [] if special or not t["special"]
        ]
        splits = spec["pre_tokenizer"] or {}
        self.by_piece = (
            spec["normalizer"] is None
            and splits.get("type") == "ByteLevel"
            and splits.get("use_regex", True)
            and not splits.get("add_prefix_space", True)
        )
        self.memo = Memo(REMEMBERED)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], []
        for at in range(0, len(texts), 4096):
            for found in self.tokenizer.encode_batch_fast(
                texts[at : at + 4096], add_special_tokens=False
            ):
                ids = found.ids
                lengths.append(len(ids))
                flat += ids
        return np.array(flat, dtype=np.int32), np.array(lengths, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the limits of each text in them."""
        if not self.by_piece:
            ids, lengths = self._ids([text or "" for text in texts.to_pylist()])
            return ids, np.append(0, np.cumsum(lengths))
        spelled = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            spelled |= np.asarray(pc.match_substring(texts, token).fill_null(False))
        if not spelled.any():
            return self._by_piece(texts)
        ids, limits = self._by_piece(pc.if_else(pa.array(spelled), "", texts))
        whole, sizes = self._ids(texts.filter(pa.array(spelled)).to_pylist())
        lengths = np.diff(limits)
        lengths[spelled] = sizes
        ids = np.insert(ids, np.repeat(limits[:-1][spelled], sizes), whole)
        return ids, np.append(0, np.cumsum(lengths))

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, limits = tb.text_bytes(texts)
        start = pieces(data, limits)
        end = np.append(start[1:], len(data))[: len(start)]
        hashes = tb.run_hashes(data, start, end)
        keys, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.memo.trim()
        new = self.memo.missing(keys)
        raw, at = data.tobytes(), sample[new]
        some = [
            raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)
        ]
        ids, lengths = self._ids(some)
        self.memo.add(keys[new], lengths, ids)
        ids, lengths = self.memo.gather(self.memo.places(keys)[kind])
        return ids, np.append(0, np.cumsum(lengths))[np.searchsorted(start, limits)]


@cache
def _encoder(path: str, special: bool) -> Encoder:
    return Encoder(path, special)


def _encode(path: str, end: int | None, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = _encoder(path, special), 0
        for block in tb.blocks(batches):
            ids, limits = encode(block.column("text"))
            if end is not None:
                ids = np.insert(ids, limits[1:], end)
                limits = limits + np.arange(len(limits))
            yield pa.record_batch({
                "doc_id": block.column("doc_id"),
                "place": pa.array(place + limits[:-1]),
                "n_tokens": pa.array(np.diff(limits)),
                "tokens": pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids)),
            })
            place += int(limits[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int | None = 0,
    key: str = "doc_id",
    text: str = "text",
    special: bool = False,
) -> None:
    """Encode every whole text and write doc_id, part, place, n_tokens, tokens to `path`.

    Files and rows are in ascending id order (null ids first, rows of one id by text);
    `part` numbers the stretches of that order, `place` counts the tokens before the
    row in its part. `end` is appended to each document. Null and empty texts have the
    end id only. Rows repeating an id are all written. Other columns are not read.
    With `special`, a special token that a text spells gets its one id, as by the library's
    own encode; without, as a safeguard, it is text like any other.
    """
    base = documents(docs, key, text)
    n = parts(base)
    (
        base.repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(
            _encode(tokenizer, end, special),
            "doc_id bigint, place bigint, n_tokens bigint, tokens array<int>",
        )
        .select("doc_id", F.spark_partition_id().alias("part"), "place", "n_tokens", "tokens")
        .write.options(**LAYOUT).parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and `columns`.

    The parts' sizes come from their length column alone; there is one row for each.
    """
    table = spark.read.parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return table.join(F.broadcast(base), "part").select(  # a row for each part written
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", *columns
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        limits = (tokens.offsets.to_numpy() - tokens.offsets[0].as_py()) * 4
        flat = memoryview(tokens.flatten().to_numpy().astype("<u4").tobytes())
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"),
            "start": batch.column("start"),
            "n_tokens": batch.column("n_tokens"),
            "ids_crc32": pa.array(sums, pa.int64()),
        })


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that have `tokens`."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        _checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
