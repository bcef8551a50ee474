"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding.

A word's merges are taken from an agenda, best score first. With dropout, each candidate
that comes up is skipped if a keyed hash says so, which gives other segmentations of the
same words; every one decodes to the same text. The key is the seed, the document, and the
place of the word in it: every occurrence of every word draws for itself. So a result depends
on seed and document alone, not on partitioning or retries. Draws that skip the same
candidates of a word give the same pieces, which a worker computes once.

Words are segmented together: the agenda runs on a matrix of all words of one length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, row_key
from curbside.llm.memo import Memo

#: The character that stands for a blank in a piece.
_BLANK = "▁"
_NEVER = np.int64(1) << 40
#: Longer words have their agenda on a heap, one by one.
_MATRIX = 24
#: Segmentations a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
#: Pieces decoded at a time.
_DECODED = 1 << 19


class Pieces:
    """Merges, byte pieces and texts of a BPE model with byte fallback; texts alone if it
    shall only decode."""

    def __init__(self, path: str, encodes: bool = True):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.ids: dict[str, int] = {}
        texts, scores = [], {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                self.ids[piece], scores[piece] = i, model.get_score(i)
                texts.append(piece.replace(_BLANK, " ").encode())
        self.text_start = np.cumsum([0, *map(len, texts)])
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not encodes:
            return
        if (self.bytes < 0).any():
            raise ValueError("this model has no byte pieces: not every text can be encoded")
        if any(_BLANK in p.lstrip(_BLANK) for p in self.ids):
            raise ValueError("pieces of this model cross words")
        # Neighbours that no piece holds together are never merged, nor is what lies
        # beyond them: texts are cut there. Only pairs of ASCII characters are looked at.
        self.cuts = np.zeros((256, 256), dtype=bool)
        self.cuts[:128, :128] = True
        for text in (p.replace(_BLANK, " ") for p in self.ids):
            for a, b in zip(text, text[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.cuts[ord(a), ord(b)] = False
        self.chars = np.full(1 << 16, -2, dtype=np.int64)  # -2: as byte pieces
        for piece, i in self.ids.items():
            if len(piece) == 1 and ord(piece) < 1 << 16 and piece != _BLANK:
                self.chars[ord(piece)] = i
        self.chars[0x20] = self.ids[_BLANK]
        order = sorted(scores, key=lambda p: (-scores[p], self.ids[p]))
        ranks: dict[str, int] = {}
        for piece in order:  # equal scores have equal ranks
            last = len(ranks) and ranks[previous]
            ranks[piece] = last if len(ranks) and scores[piece] == scores[previous] else last + 1
            previous = piece
        pairs = [
            (self.ids[p[:i]] * size + self.ids[p[i:]], ranks[p], self.ids[p])
            for p in self.ids
            for i in range(1, len(p))
            if p[:i] in self.ids and p[i:] in self.ids
        ]
        pairs.sort()
        self.size = size
        self.keys, self.ranks, self.merged = (
            np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)
        )
        self.merges = {key: (rank, merged) for key, rank, merged in pairs}
        self.memo = Memo(REMEMBERED)

    def symbols(self, word: str) -> list[int]:
        """Characters as piece ids; those without one, and the literal blank sign, as
        byte pieces, which merge with nothing."""
        out = []
        for c in word:
            i = None if c == _BLANK else self.ids.get(_BLANK if c == " " else c)
            out += [i] if i is not None else self.bytes[list(c.encode())].tolist()
        return out

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of two symbols; rank _NEVER if there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NEVER), self.merged[at]

    def matrix(
        self, symbols: np.ndarray, skips: np.ndarray, more=None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Segment rows of symbols (-1 behind the last). Bit k % 32 of a row's `skips`
        skips the k-th candidate; past each 32, `more(rows, k // 32)` has the next ones.
        Returns the rows merged and the candidates seen."""
        rows, width = symbols.shape
        symbols = np.hstack([symbols, np.full((rows, 1), -1, dtype=np.int64)])
        rank = np.full((rows, width + 1), _NEVER)
        to = np.zeros((rows, width + 1), dtype=np.int64)
        rank[:, :width], to[:, :width] = self.pair(symbols[:, :-1], symbols[:, 1:])
        seen = np.zeros(rows, dtype=np.int64)
        active, columns = np.arange(rows), np.arange(width + 1)
        skips = skips.copy()
        while len(active):
            at = rank[active].argmin(axis=1)
            open_ = rank[active, at] < _NEVER
            active, at = active[open_], at[open_]
            skip = (skips[active] >> (seen[active] & 31)) & 1 == 1
            seen[active] += 1
            full = active[seen[active] & 31 == 0]
            if more and len(full):
                skips[full] = more(full, seen[full] >> 5)
            rank[active[skip], at[skip]] = _NEVER
            some, at = active[~skip], at[~skip]
            if not len(some):
                continue
            new = to[some, at]
            source = np.minimum(columns + (columns > at[:, None]), width)
            for table, blank in ((symbols, -1), (rank, _NEVER), (to, 0)):
                moved = np.take_along_axis(table[some], source, axis=1)
                moved[:, width] = blank
                table[some] = moved
            symbols[some, at] = new
            rank[some, at], to[some, at] = self.pair(new, symbols[some, at + 1])
            inner = at > 0
            some, at, new = some[inner], at[inner] - 1, new[inner]
            rank[some, at], to[some, at] = self.pair(symbols[some, at], new)
        return symbols[:, :width], seen

    def heap(self, symbols: list[int], skips: int, more=None) -> tuple[list[int], int]:
        """The same for one long word."""
        n, seen = len(symbols), 0
        symbols, after = list(symbols), list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda: list[tuple] = []
        skipped = set()

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= n:
                return
            if found := self.merges.get(symbols[i] * self.size + symbols[j]):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, left, right, merged = heapq.heappop(agenda)
            if symbols[i] != left or after[i] >= n or symbols[after[i]] != right:
                continue
            if (i, after[i], left, right) in skipped:
                continue
            skip = skips >> (seen & 31) & 1
            seen += 1
            if more and seen & 31 == 0:
                skips = more(seen >> 5)
            if skip:
                skipped.add((i, after[i], left, right))
                continue
            j = after[i]
            symbols[i], symbols[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0], seen

    def segment(
        self, chars: np.ndarray, start: np.ndarray, end: np.ndarray, skips: np.ndarray, string,
        more=None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, ids and candidates seen of the words `chars[start:end]` (piece ids).
        Words that hold other characters come from `string(i)`, as long ones do."""
        rows = len(start)
        width = end - start
        simple = width <= _MATRIX
        odd = np.append(0, np.cumsum(chars < 0))
        simple &= odd[end] == odd[start]
        out_length = np.zeros(rows, dtype=np.int64)
        out_seen = np.zeros(rows, dtype=np.int64)
        order, flat = [], []
        low = 0
        for step in (2, 3, 4, 5, 6, 8, 10, 12, 16, _MATRIX):
            which = np.flatnonzero(simple & (width > low) & (width <= step))
            low = step
            for part in np.array_split(which, len(which) // 8192 + 1):
                if not len(part):
                    continue
                at = start[part][:, None] + np.arange(step)
                table = np.where(
                    at < end[part][:, None], chars[np.minimum(at, len(chars) - 1)], -1
                )
                table, out_seen[part] = self.matrix(
                    table, skips[part], more and (lambda rows, k, part=part: more(part[rows], k))
                )
                real = table >= 0
                out_length[part] = real.sum(axis=1)
                order.append(part)
                flat.append(table[real])
        for i in np.flatnonzero(~simple).tolist():
            ids, out_seen[i] = self.heap(
                self.symbols(string(i)), int(skips[i]),
                more and (lambda k, i=i: int(more(np.array([i]), np.array([k]))[0])),
            )
            out_length[i] = len(ids)
            order.append(np.array([i]))
            flat.append(np.array(ids, dtype=np.int64))
        if not order:
            return out_length, np.empty(0, np.int64), out_seen
        order, flat = np.concatenate(order), np.concatenate(flat)
        # From the order of computation back to that of the words.
        lengths = out_length[order]
        at = np.empty(rows, dtype=np.int64)
        at[order] = np.cumsum(lengths) - lengths
        return out_length, flat[tb.ranges(at, out_length)], out_seen

    def decode(self, ids: np.ndarray, limits: np.ndarray) -> list[bytes]:
        """Texts of the id sequences between `limits`, without the blank put first."""
        length = self.text_start[ids + 1] - self.text_start[ids]
        letters = self.text[tb.ranges(self.text_start[ids], length)]
        at = np.append(0, np.cumsum(length))[limits]
        return [
            bytes(letters[a + 1 : b]) if b > a else b""
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
        ]


@cache
def _pieces(path: str, encodes: bool = True) -> Pieces:
    return Pieces(path, encodes)


def _skips(keys: np.ndarray, drop: float) -> np.ndarray:
    """32 bits for each key, each set with probability `drop` (in 256ths)."""
    limit = round(drop * 256)
    if limit >= 256:
        return np.full(len(keys), 0xFFFFFFFF, dtype=np.int64)
    out = np.zeros(len(keys), dtype=np.int64)
    for block in range(4):
        keys = tb.mix(keys + np.uint64(0x9E3779B97F4A7C15))
        bits = keys.view(np.uint8).reshape(-1, 8) < limit
        out |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.int64) << (8 * block)
    return out


def _low_bits(n: np.ndarray) -> np.ndarray:
    return (1 << np.minimum(n, 32)) - 1


def _more_skips(keys: np.ndarray, drop: float):
    """For rows of `keys`, the bits of their candidates from 32 * k on, k > 0."""
    def more(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        return _skips(tb.mix(keys[rows] ^ tb.mix(k.astype(np.uint64))), drop)

    return more


def encode_block(
    model: Pieces, texts: pa.Array, rows: np.ndarray, seed: int, drop: float
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the limits of each text in them."""
    data, limits = tb.text_bytes(texts)
    raw, size = data.tobytes(), len(data)
    begins = np.zeros(size, dtype=bool)
    begins[1:] = model.cuts[data[:-1], data[1:]]
    begins[limits[:-1][np.diff(limits) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], size)[: len(start)]
    first = np.searchsorted(start, limits)
    n = np.diff(first)
    hashes = tb.run_hashes(data, start, end)
    leads = first[:-1][n > 0]
    hashes[leads] = tb.mix(hashes[leads] + np.uint64(1))  # they get a blank put before
    lead = np.zeros(len(start), dtype=bool)
    lead[leads] = True

    points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
    chars = np.append(model.chars, -2)[np.minimum(points, 1 << 16)]
    char = np.cumsum((data & 0xC0) != 0x80)
    char_at = np.append(char - 1, len(points))  # of each byte that begins one

    def run(words: np.ndarray, skips: np.ndarray, more=None):
        def string(i: int) -> str:
            w = words[i]
            return (" " if lead[w] else "") + raw[start[w] : end[w]].decode()

        a, b = char_at[start[words]], char_at[end[words]]
        # A word with a blank put before takes the slow way: mark it as odd.
        own = lead[words]
        if own.any():
            extra = len(chars)
            a = np.where(own, extra, a)
            b = np.where(own, extra + 1, b)
            return model.segment(np.append(chars, -2), a, b, skips, string, more)
        return model.segment(chars, a, b, skips, string, more)

    memo = model.memo
    memo.trim()
    if memo.used > 16 * REMEMBERED:  # long words, which seldom come again
        memo.clear()
    kinds, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
    new = memo.missing(kinds)
    memo.add(kinds[new], *run(sample[new], np.zeros(len(new), dtype=np.int64)))
    places = memo.places(kinds)
    if drop > 0:
        seen = memo.extra[places][kind]
        place = np.arange(len(start)) - np.repeat(first[:-1], n)
        draw = tb.mix(np.repeat(rows.view(np.uint64), n) + np.uint64(seed & 0xFFFFFFFF))
        draw = tb.mix(draw + place.astype(np.uint64))
        # The rate is part of the key: a worker remembers what it made with others.
        own = ((seed << 20) + round(drop * 256)) & 0xFFFFFFFFFFFFFFFF
        keys = tb.mix(hashes + tb.mix(draw + np.uint64(own)))
        skips = _skips(keys, drop)
        target = kinds[kind]
        # Without a skip among the candidates that come up, a word is segmented as usual.
        hit = (skips & _low_bits(seen) != 0) | (seen > 32)
        # Most skips bring few more candidates up: the first bits tell the result, and the
        # same bits of the same word are computed once.
        some = np.flatnonzero(hit & (seen <= 15))
        bits = 2 * seen[some] + 2
        low = skips[some] & _low_bits(bits)
        by_bits = tb.mix(hashes[some] ^ tb.mix(low.astype(np.uint64) + np.uint64(0x5BD1E995)))
        known, at, which = np.unique(by_bits, return_index=True, return_inverse=True)
        new = memo.missing(known)
        memo.add(known[new], *run(some[at[new]], low[at[new]]))
        told = memo.extra[memo.places(known)][which] <= bits
        target[some[told]] = by_bits[told]
        hit[some[told]] = False
        # All others are computed for each occurrence.
        rest = np.flatnonzero(hit)
        own, at = np.unique(keys[rest], return_index=True)
        new = memo.missing(own)
        at = rest[at[new]]
        memo.add(own[new], *run(at, skips[at], _more_skips(own[new], drop)))
        target[rest] = keys[rest]
        kinds, kind = np.unique(target, return_inverse=True)
        places = memo.places(kinds)
    ids, lengths = memo.gather(places[kind])
    return ids, np.append(0, np.cumsum(lengths))[first]


def _encode(path: str, seed: int, drop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path)
        for block in tb.blocks(batches):
            rows = block.column("row").to_numpy(zero_copy_only=False)
            ids, limits = encode_block(model, block.column("text"), rows, seed, drop)
            pieces = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids))
            yield pa.record_batch({
                **{c: block.column(c) for c in block.schema.names if c not in ("text", "row")},
                "pieces": pieces,
            })

    return run


def encode_pieces(
    docs: DataFrame,
    model: str,
    seed: int = 17,
    drop: float = 0.1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, pieces: whole texts as ids of the SentencePiece BPE model at `model`, each
    candidate merge skipped with probability `drop` (0: the model's own encoding).

    `decode_pieces` gives the text back, character by character, also with the blank sign
    U+2581, control characters or runs of blanks in it. Null and empty texts have no
    pieces. Rows repeating id and text have equal pieces; other rows differ, also with
    equal texts. A null id takes part like any other. Other columns are not read.
    """
    rows = documents(docs, key, text).select("doc_id", row_key().alias("row"), "text")
    return rows.mapInArrow(
        _encode(model, seed, drop), "doc_id bigint, pieces array<int>"
    )


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path, encodes=False)
        for batch in batches:
            limits = batch.column("pieces").offsets.to_numpy()
            ids = batch.column("pieces").values.to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(limits, limits[at] + _DECODED, side="right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                texts = model.decode(
                    ids[limits[at] : limits[to]], limits[at : to + 1] - limits[at]
                )
                yield pa.record_batch({
                    **{c: batch.column(c).slice(at, to - at)
                       for c in batch.schema.names if c != "pieces"},
                    "text": pa.array(texts, pa.binary()).cast(pa.string()),
                })
                at = to

    return run


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """`rows` with the text of their `pieces` in place of them. Null pieces are empty."""
    real = rows.withColumn("pieces", F.coalesce("pieces", F.array().cast("array<int>")))
    schema = StructType([f for f in rows.schema if f.name != "pieces"]).add("text", "string")
    return real.mapInArrow(_decode(model), schema)
