"""Phrase collocations: counts by weighted automata, scores by lookups of phrase parts.

Four steps, each a Spark job over written tables:

1. Words are tallied by 64-bit keys. Those frequent enough to be part of a phrase get numbers
   in the order of their keys; if there are too many of them for every task to know, they
   keep their keys, and a bitmap of fixed size rules out most others. Every task also gives
   a sample of its word windows, from which the limits of the prefix ranges are taken, so
   that ranges are even however often a word or a pair occurs.
2. Every task sorts its windows of up to `width` such words, a shard at a time, and builds
   count transducers of them, one for each prefix range the shard has windows of.
3. The transducers of a range are united, weights of equal windows summed. Phrases of
   `least` occurrences or more remain; those that a range limit cuts are added up.
4. The counts are transducers again, and each range's is composed with the parts of all
   candidates that fall into the range. A candidate's score is that of its worst cut. The
   words of the best phrases are read from the texts at the end.

A range that many candidates ask for is copied, so that no task gets more than
`_ASKED` questions. What the driver sees are the ranges' limits and the numbered keys or the
bitmap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.llm import textblocks as tb
from curbside.llm.automata import Transducer, counted, distinct, merged, nodes, ranked, summed
from curbside.llm.common import materialise

__all__ = ["collocations"]

#: Windows of a shard, and of a range (all shards' windows counted), about.
SHARD = 1_000_000
RANGE = 1_000_000
#: Prefix ranges at most; beyond, they grow.
RANGES = 100_000
#: One window in this many is in the sample that the limits are taken from.
SAMPLED = 1024
#: Words that are numbered, at most (32 MB), and bits of a key that choose its place in the
#: bitmap beyond (8 MB).
NUMBERED = 1 << 22
BITMAP = 26
_LIMITS_FROM = 16  # sampled windows a range, at most
#: Questions that one task answers.
_ASKED = 1_000_000
#: Parts a language's ranking is cut into before its best are compared in one place.
_SPREAD = 64
#: Words a task remembers before it hands its tally on.
_WORDS = 1_000_000

_BREAKS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_WORD_BYTES = tb.byte_classes(bytes([0x20, 0x09, *np.flatnonzero(_BREAKS).tolist()]))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20


@lru_cache(maxsize=4096)
def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _words(block: pa.RecordBatch) -> tuple[tb.Tokens, np.ndarray, np.ndarray]:
    """The block's words, their keys (never 0; the language is part of the key), and how
    many words each has from itself to the end of its piece."""
    tokens = tb.tokenise(block.column("text"), _WORD_BYTES, tb.LOWER)
    langs = np.array([_language(x) for x in block.column("lang").to_pylist()], dtype=np.uint64)
    keys = tb.mix(tokens.hashes ^ np.repeat(langs, tokens.counts))
    keys[keys == 0] = 1
    n = len(keys)
    breaks = np.append(0, np.cumsum(_BREAKS[tokens.data]))
    last = np.ones(n, dtype=bool)
    last[:-1] = breaks[tokens.start[1:]] > breaks[tokens.end[:-1]]
    ends = tokens.first[1:]
    last[ends[ends > 0] - 1] = True
    stops = np.flatnonzero(last)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1 if n else stops
    return tokens, keys, left


def _windows(values: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """The window of up to `width` values that begins at each place; 0 past its piece."""
    out = np.zeros((len(values), width), dtype=values.dtype)
    for d in range(width):
        here = np.flatnonzero(left > d)
        out[here, d] = values[here + d]
    return out


def _sortable(windows: np.ndarray) -> np.ndarray:
    """Rows of keys as byte strings in the same order."""
    wide = np.ascontiguousarray(windows.astype(">u8"))
    return wide.view(f"S{8 * windows.shape[1]}").reshape(-1)


def _strings(tokens: tb.Tokens, at: np.ndarray) -> pa.Array:
    """The words at the places `at`, A-Z in lower case."""
    lengths = tokens.end[at] - tokens.start[at]
    flat = _LOWERED[tokens.data[tb.ranges(tokens.start[at], lengths)]]
    limits = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(
        len(at), pa.py_buffer(limits.tobytes()), pa.py_buffer(flat.tobytes())
    )


def _record(types: dict[str, pa.DataType], rows: int, **columns) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    return pa.RecordBatch.from_pydict({
        name: pa.array(columns[name], kind) if name in columns else pa.nulls(rows, kind)
        for name, kind in types.items()
    })


_TALLY = {"key": pa.int64(), "n": pa.int64(), "lang": pa.string(), "sample": pa.binary()}


def _tally(width: int, sampled: int):
    """Rows of two kinds: a word's key, number and language; a sample."""

    def merge(parts: list) -> tuple[np.ndarray, ...]:
        keys, first, kind = np.unique(
            np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True
        )
        counts = np.bincount(kind, np.concatenate([p[1] for p in parts]), len(keys))
        return keys, counts.astype(np.int64), np.concatenate([p[2] for p in parts])[first]

    def rows(part: tuple, langs: list[str]) -> pa.RecordBatch:
        names = pa.DictionaryArray.from_arrays(pa.array(part[2]), pa.array(langs, pa.string()))
        return _record(_TALLY, len(part[0]), key=part[0].view(np.int64), n=part[1],
                       lang=names.cast(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, numbers = [], 0, {}
        for block in tb.blocks(batches):
            tokens, keys, left = _words(block)
            lang = np.array(
                [numbers.setdefault(x, len(numbers)) for x in block.column("lang").to_pylist()],
                dtype=np.int32,
            )
            distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
            owner = np.searchsorted(tokens.first, first, side="right") - 1
            parts.append((distinct, counts, lang[owner]))
            size += len(distinct)
            if size > _WORDS // 2:
                parts = [merge(parts)]
                size = len(parts[0][0])
                if size > _WORDS // 2:
                    yield rows(parts[0], list(numbers))
                    parts, size = [], 0
            some = np.arange(len(keys) % sampled, len(keys), sampled)
            windows = np.zeros((len(some), width), dtype=np.uint64)
            for d in range(width):
                here = left[some] > d
                windows[here, d] = keys[some[here] + d]
            if len(some):
                raw, step = np.unique(_sortable(windows)).tobytes(), 8 * width
                samples = [raw[i : i + step] for i in range(0, len(raw), step)]
                yield _record(_TALLY, len(samples), sample=samples)
        if parts:
            yield rows(merge(parts), list(numbers))

    return run


class Codes:
    """Codes of words, in the order of their keys: 0 for a word that is in no phrase, and else
    its number among the frequent ones, or, with a bitmap of them alone, its key."""

    def __init__(self, frequent: np.ndarray | None, bitmap: np.ndarray | None = None):
        self.frequent, self.bitmap = frequent, bitmap

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.frequent is None:
            return np.where(_marked(self.bitmap, keys, 64), keys, np.uint64(0))
        at = np.searchsorted(self.frequent, keys)
        hit = at < len(self.frequent)
        hit[hit] = self.frequent[at[hit]] == keys[hit]
        return np.where(hit, at + 1, 0).astype(np.uint64)

    def limits(self, windows: np.ndarray) -> np.ndarray:
        """For limits of ranges: windows of codes that are in the same order."""
        if self.frequent is None:
            return windows
        above = np.searchsorted(self.frequent, windows, side="left") + 1
        return np.where(windows > 0, above, 0).astype(np.uint64)

    @property
    def bits(self) -> int:
        """Bits that the codes fit."""
        return 64 if self.frequent is None else max(len(self.frequent).bit_length(), 1)


def _marked(bitmap: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bitmap has a code's place: the first `BITMAP` bits of a key, or a number."""
    place = codes >> np.uint64(64 - BITMAP) if bits == 64 else codes
    shift = (place & np.uint64(7)).astype(np.uint8)
    return (bitmap[place >> np.uint64(3)] >> shift & 1).astype(bool)


def _bitmap(codes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each place that a code has: 2 ** (BITMAP - 6) rows at most."""
    place = F.shiftrightunsigned(column, bits - BITMAP) if bits == 64 else F.col(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    found = codes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), dtype="<i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _codes(frequent: DataFrame) -> Codes:
    if frequent.count() > NUMBERED:
        return Codes(None, _bitmap(frequent, "key", 64))
    keys = frequent.select("key").toArrow().column("key").to_numpy()
    return Codes(np.sort(keys.astype(np.int64).view(np.uint64)))


def _coded(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_pydict({
                "code": pa.array(code.view(np.int64)), "lang": batch.column("lang")
            })

    return run


def _named(codes: Codes, wanted: np.ndarray):
    """The words of the codes that a bitmap has, once for each block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            tokens, keys, _ = _words(block)
            distinct, first = np.unique(keys, return_index=True)
            code = codes(distinct)
            mine = (code > 0) & _marked(wanted, code, codes.bits)
            if mine.any():
                yield pa.RecordBatch.from_pydict({
                    "code": pa.array(code[mine].view(np.int64)),
                    "word": _strings(tokens, first[mine]).cast(pa.string()),
                })

    return run


def _count(limits: np.ndarray, codes: Codes, width: int, shard: int):
    def build(blocks: list) -> Iterator[pa.RecordBatch]:
        every, kind = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
        code = codes(every)
        common = code > 0
        ranks = np.where(common, np.cumsum(common), 0).astype(np.int32)[kind]
        names = np.append(np.uint64(0), code[common])
        windows = _windows(ranks, np.concatenate([b[1] for b in blocks]), width)
        for d in range(1, width):  # nothing goes on behind a word that is in no phrase
            windows[windows[:, d - 1] == 0, d] = 0
        rows, counts = counted(windows[windows[:, 0] > 0])
        del windows
        cuts = np.searchsorted(_sortable(names[rows]), limits) if len(limits) else limits
        cuts = [0, *(int(c) for c in cuts), len(rows)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                here = np.zeros(len(names), dtype=bool)
                here[rows[a:b].ravel()] = True
                here[0] = True
                place = (np.cumsum(here) - 1).astype(np.int32)
                blob = Transducer.build(names[here], place[rows[a:b]], counts[a:b]).encode()
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([i], pa.int32()), "counts": pa.array([blob], pa.binary())
                })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = [], 0
        for block in tb.blocks(batches):
            _, keys, left = _words(block)
            if size and size + len(keys) > shard:
                yield from build(blocks)
                blocks, size = [], 0
            blocks.append((keys, np.minimum(left, width).astype(np.int8)))
            size += len(keys)
        if size:
            yield from build(blocks)

    return run


def _unite(limits: np.ndarray, width: int, least: int):
    size = 8 * width

    def run(table: pa.Table) -> pa.Table:
        here = table.column("range")[0].as_py()
        parts = [Transducer.decode(b.as_py()) for b in table.column("counts")]
        keys, rows, counts = merged(parts)
        del parts
        total = np.append(0, np.cumsum(counts))
        # Prefixes of the range's limits may go on in the ranges beside it.
        edges = limits[max(here - 1, 0) : here + 1] if here else limits[:1]
        edges = [np.frombuffer(e.ljust(size, b"\0"), dtype=">u8") for e in edges.tolist()]
        found = []
        for d, (at, end) in enumerate(nodes(rows), 1):
            n, prefix = total[end] - total[at], keys[rows[at, :d]]
            keep = n >= least
            for edge in edges:
                keep |= (prefix == edge[:d].astype(np.uint64)).all(axis=1)
            out = np.zeros((int(keep.sum()), width + 1), dtype=np.int64)
            out[:, :d], out[:, width] = prefix[keep].view(np.int64), n[keep]
            found.append(out)
        out = np.concatenate(found)
        names = [*_columns("h", width), "n"]
        return pa.table({name: pa.array(out[:, i]) for i, name in enumerate(names)})

    return run


def _columns(letter: str, width: int) -> list[str]:
    return [f"{letter}{d}" for d in range(1, width + 1)]


def _keys(batch, letter: str, width: int) -> np.ndarray:
    columns = [batch.column(c).to_numpy() for c in _columns(letter, width)]
    return np.stack(columns, axis=1).astype(np.int64, copy=False).view(np.uint64)


def _place(limits: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The range each window is in."""
    if not len(limits):
        return np.zeros(len(windows), dtype=np.int32)
    return np.searchsorted(limits, _sortable(windows), side="right").astype(np.int32)


def _placed(limits: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _place(limits, _keys(batch, "h", width))
            yield batch.append_column("range", pa.array(place))

    return run


def _questions(limits: np.ndarray, width: int):
    """For every candidate and cut, the part before it (slot 2 * cut) and the part behind
    it (the next slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _keys(batch, "h", width)
            words = (whole != 0).sum(axis=1)
            for cut in range(1, width):
                some = np.flatnonzero(words > cut)
                if not len(some):
                    continue
                for slot, part in ((2 * cut, whole[some, :cut]), (2 * cut + 1, whole[some, cut:])):
                    padded = np.zeros((len(some), width), dtype=np.uint64)
                    padded[:, : part.shape[1]] = part
                    yield pa.RecordBatch.from_pydict({
                        "range": pa.array(_place(limits, padded)),
                        "slot": pa.array(np.full(len(some), slot, dtype=np.int32)),
                        **{c: pa.array(padded[:, i].view(np.int64))
                           for i, c in enumerate(_columns("p", width))},
                        **{c: batch.column(c).take(pa.array(some))
                           for c in (*_columns("h", width), "n")},
                    })

    return run


def _automaton(width: int):
    """The counted phrases of a range as a transducer."""

    def run(table: pa.Table) -> pa.Table:
        keys, ranks = ranked(_keys(table, "h", width))
        rows, n = summed(ranks, table.column("n").to_numpy())
        depths, own = nodes(rows), n.copy()
        # A row's weight is what does not go on to a longer row. It stands before those. A
        # row whose prefix is not here has it in a range before, where alone it is asked for.
        for d in range(1, width):
            at, above = depths[d][0], depths[d - 1][0]
            if len(at):
                parent = above[np.searchsorted(above, at, side="right") - 1]
                has = rows[parent, d] == 0
                np.subtract.at(own, parent[has], n[at[has]])
        blob = Transducer.build(keys, rows, own).encode()
        return pa.table({
            "range": table.column("range").slice(0, 1), "counts": pa.array([blob], pa.binary())
        })

    return run


def _answers(width: int):
    def run(questions: pa.Table, counts: pa.Table) -> pa.Table:
        names = [*_columns("h", width), "n", "slot"]
        if not questions.num_rows:
            found = np.empty(0, dtype=np.int64)
        else:
            keys, ranks = ranked(_keys(questions, "p", width))
            rows, which = distinct(ranks)
            table = Transducer.decode(counts.column("counts")[0].as_py())
            found = table.compose(keys, rows)[which]
        return questions.select(names).append_column("found", pa.array(found))

    return run


def _limits(tally: DataFrame, codes: Codes, sampled: int, size: int, width: int) -> np.ndarray:
    """Lower limits of all ranges but the first, as sortable byte strings. They only decide
    which task has which windows."""
    samples = tally.filter("sample is not null").select("sample")
    n = min(-(-samples.count() * sampled // size), RANGES)
    if n < 2:
        return np.empty(0, dtype=f"S{8 * width}")
    some = samples.orderBy(F.xxhash64("sample"), "sample").limit(_LIMITS_FROM * n).collect()
    raw = b"".join(bytes(r[0]) for r in some)
    windows = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, width)
    found = np.sort(_sortable(codes.limits(windows)))
    return np.unique(found[np.arange(1, n) * len(found) // n])


def _score(before: Column, behind: Column, n: Column, scale: int) -> Column:
    """floor(scale * n / (before + behind)) in whole numbers of any size."""
    wide = "decimal(38,0)"
    product = n.cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    total = before.cast("decimal(19,0)") + behind.cast("decimal(19,0)")
    return F.call_function("div", product.cast(wide), total.cast(wide))


def _parts_of(width: int) -> Column:
    """The stretches of two or more words inside a longer phrase, as structs of keys."""
    keys = _columns("h", width)
    out = []
    for words in range(3, width + 1):
        exact = F.col(keys[words - 1]) != 0
        if words < width:
            exact &= F.col(keys[words]) == 0
        for size in range(2, words):
            for at in range(words - size + 1):
                inner = keys[at : at + size]
                columns = [F.col(c) for c in inner] + [F.lit(0).cast("bigint")] * (width - size)
                whole = F.struct(*(c.alias(k) for c, k in zip(columns, keys, strict=True)))
                out.append(F.when(exact, whole))
    return F.array_compact(F.array(*out))


def _best(df: DataFrame, order: list[Column], top: int, ties: bool, parts: int) -> DataFrame:
    """The first `top` of each language and part of it."""
    spread = F.pmod(F.xxhash64("h1", "h2"), F.lit(parts))
    window = Window.partitionBy("lang", spread).orderBy(*order)
    place = F.rank() if ties else F.row_number()
    return df.withColumn("rank", place.over(window)).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    least: int = 30,
    width: int = 4,
    top: int = 2000,
    subsumed: int = 80,
    scale: int = 2_000_000,
    lang: str = "lang",
    text: str = "text",
    shard: int = SHARD,
    size: int = RANGE,
    sampled: int = SAMPLED,
) -> DataFrame:
    """The phrases of 2 to `width` words that stick together most, for each language: lang,
    rank, phrase, a (its occurrences), l and r (those of the two parts of its worst cut), n
    (words of the language), score (floor(scale * a / (l + r))).

    A phrase occurs `least` times at least, inside one piece between punctuation or line
    ends. It is left out if a longer phrase around it, itself kept or not, occurs `subsumed`
    % as often or more. Order: score, a (both descending), phrase by UTF-8 bytes.

    Null and empty texts have no words; a null language is `und`. Rows count as often as
    they repeat; ids play no part. An empty table gives no rows. Nothing but language and
    text is read, so other names can't clash. Words are told apart by 64-bit keys; should a
    word of the result share its key with another, that is a named error.
    """
    if width < 2:
        raise ValueError("phrases have two words at least")
    base = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.col(text).cast("string").alias("text"),
    )
    keys = _columns("h", width)
    kinds = "key bigint, n bigint, lang string, sample binary"
    tally = materialise(base.mapInArrow(_tally(width, sampled), kinds), "tally")
    words = tally.filter("key is not null")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    common = words.groupBy("key", "lang").agg(F.sum("n").alias("n"))
    frequent = materialise(common.filter(F.col("n") >= least).select("key", "lang"), "frequent")
    codes = _codes(frequent)
    langs = frequent.mapInArrow(_coded(codes), "code bigint, lang string")
    limits = _limits(tally, codes, sampled, size, width)

    long = ", ".join(f"{c} bigint" for c in (*keys, "n"))
    shards = base.mapInArrow(_count(limits, codes, width, shard), "range int, counts binary")
    phrases = (
        shards.groupBy("range").applyInArrow(_unite(limits, width, least), long)
        .groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    )
    counts = materialise(phrases, "counts")

    tables = counts.mapInArrow(_placed(limits, width), f"{long}, range int")
    tables = tables.groupBy("range").applyInArrow(_automaton(width), "range int, counts binary")
    candidates = counts.filter("h2 <> 0")
    parts = ", ".join(f"{c} bigint" for c in _columns("p", width))
    asked = materialise(
        candidates.mapInArrow(
            _questions(limits, width), f"range int, slot int, {parts}, {long}"
        ),
        "questions",
    )
    copies = asked.groupBy("range").agg(
        F.ceil(F.count("*") / _ASKED).cast("int").alias("copies")
    )
    tables = tables.join(copies, "range").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    asked = asked.join(F.broadcast(copies), "range").withColumn(  # a row for each range
        "copy", F.pmod(F.xxhash64(*keys), F.col("copies")).cast("int")
    )
    found = asked.groupBy("range", "copy").cogroup(
        tables.select("range", "copy", "counts").groupBy("range", "copy")
    ).applyInArrow(_answers(width), f"{long}, slot int, found bigint")
    slots = found.groupBy(*keys, "n").agg(*(
        F.max(F.when(F.col("slot") == slot, F.col("found"))).alias(f"s{slot}")
        for slot in range(2, 2 * width)
    ))
    cuts = [
        F.when(F.col(f"s{2 * cut}").isNotNull(), F.struct(
            _score(F.col(f"s{2 * cut}"), F.col(f"s{2 * cut + 1}"), F.col("n"), scale).alias("score"),
            F.lit(cut).alias("cut"),
            F.col(f"s{2 * cut}").alias("l"),
            F.col(f"s{2 * cut + 1}").alias("r"),
        ))
        for cut in range(1, width)
    ]
    scored = slots.withColumn("worst", F.array_min(F.array_compact(F.array(*cuts)))).select(
        *keys, F.col("n").alias("a"), "worst.score", "worst.l", "worst.r"
    )
    around = candidates.select(F.explode(_parts_of(width)).alias("part"), "n").select(
        "part.*", "n"
    ) if width > 2 else candidates.select(*keys, "n").filter(F.lit(False))
    around = around.groupBy(*keys).agg(F.max("n").alias("around"))
    wide = F.col("around").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * subsumed
    alone = scored.join(around, keys, "left").filter(
        F.col("around").isNull() | ~wide
    ).drop("around")

    order = [F.desc("score"), F.desc("a")]
    rows = _best(alone.join(langs.withColumnRenamed("code", "h1"), "h1"), order, top, True, _SPREAD)
    rows = materialise(rows.drop("rank"), "best")
    used = rows.select(F.explode(F.array(*keys)).alias("code")).filter("code <> 0")
    wanted = _bitmap(used, "code", codes.bits)
    named = base.mapInArrow(_named(codes, wanted), "code bigint, word string").distinct()
    named = materialise(named.join(used.distinct(), "code", "left_semi"), "words")
    if not named.groupBy("code").count().filter("count > 1").isEmpty():
        raise ValueError("two words have one key")
    for d, key in enumerate(keys, 1):
        one = named.select(F.col("code").alias(key), F.col("word").alias(f"w{d}"))
        rows = rows.join(one, key, "left")
    phrase = F.concat_ws(" ", *(f"w{d}" for d in range(1, width + 1)))
    rows = rows.withColumn("phrase", phrase)
    order = [*order, F.col("phrase")]
    rows = _best(_best(rows, order, top, False, _SPREAD), order, top, False, 1)
    return rows.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
