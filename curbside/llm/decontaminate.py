"""Benchmark decontamination with DataFrame operations only.

The test items' windows of normalised words are a broadcast hash table; every window of
every training document is looked up in it by hash and verified word by word in the
join. One scan does everything: each document also sends one row without a window, so
documents without hits need no second pass. What is broadcast is bounded: windows alone, a
number for each, and a larger benchmark is cut into slices by hash, one scan for each. The
items of the windows found, of which one window may have many, come by an ordinary join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import documents, materialise, row_key
from curbside.llm.folds import fold, let

#: Windows of a broadcast slice, at most.
SLICE = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS = r"[^\x00-\x7F&&[\p{IsUppercase}\p{Lt}]]"


def normalised(text: str) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. `lower` is
    much faster than `translate`, and equal to it without capitals beyond A-Z."""
    column = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(column.rlike(_CAPITALS), F.translate(column, _UPPER, _LOWER)).otherwise(
        F.lower(column)
    )
    return F.filter(F.split(lower, _BETWEEN), lambda word: word != "")


def _key(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(hashes, at + i) for i in range(width)))


def _with_hashes(rows: DataFrame) -> DataFrame:
    """`rows` with `words`, and columns n_words and h (word hashes)."""
    return rows.withColumns({
        "n_words": F.size("words"), "h": F.transform("words", lambda word: F.xxhash64(word))
    })


def _starts(n: Column, width: int) -> Column:
    """First words of the windows of `width` words among `n`; none if there are fewer."""
    some = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    return F.when(n >= width, some).otherwise(F.array().cast("array<int>"))


def _keys(n: Column, width: int) -> Column:
    """The hashes of all windows of `width` words."""
    return F.transform(_starts(n, width), lambda at: _key(F.col("h"), at, width))


def item_windows(items: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """key, len, window, item: the distinct windows of each item. An item of fewer words is
    one window."""
    base = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    words = _with_hashes(base.select("item", normalised("text").alias("words")))
    words = words.filter("n_words > 0").withColumn(
        "len", F.least(F.col("n_words"), F.lit(width))
    )
    windows = words.select(
        "item", "len", "words", "h", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("len")))
        .alias("at"),
    )
    hashed = reduce(
        lambda other, n: F.when(F.col("len") == n, _key(F.col("h"), F.col("at"), n)).otherwise(other),
        range(1, width + 1), F.lit(None).cast("bigint"),
    )
    return windows.select(
        "item", "len", hashed.alias("key"),
        F.slice("words", F.col("at") + 1, F.col("len")).alias("window"),
    ).distinct()


def _covered(spans: Column) -> Column:
    """Maximal intervals (start, end) of sorted spans (start, len)."""
    kind = "struct<start:int,end:int>"
    none = F.lit(None).cast(kind)

    def step(last, span):
        end = span["start"] + span["len"]
        joins = span["start"] <= last["end"]
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], end).alias("end")
        )
        own = F.struct(span["start"].alias("start"), end.alias("end"))
        return F.when(joins, longer).otherwise(own), F.when(joins, none).otherwise(last)

    return let(fold(spans, none, kind, step), lambda w: F.array_compact(
        F.array_append(w["all"], w["carry"])
    ))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    slice_windows: int = SLICE,
) -> DataFrame:
    """Per row: doc_id, row (a hash of id and text), n_words, n_hit, items (their ids as
    sorted strings), spans (maximal intervals of hit words, end exclusive), contaminated.

    A window is `width` consecutive words of an item; an item of fewer, but not none, is
    one window. A word of a document inside any occurrence of a window is hit. Null and
    empty texts have no words; items without words find nothing, as an empty benchmark
    does. Items of a null id hit words but are not listed. Rows that repeat id and text
    are all returned; null ids take part like others. Other columns are not looked at.
    """
    of_items = materialise(item_windows(items, width, item_key, item_text), "item_windows")
    windows = materialise(
        of_items.select("key", "len", "window").distinct()
        .withColumn("number", F.monotonically_increasing_id()),
        "windows",
    )
    lengths = {n: count for n, count in windows.groupBy("len").count().collect()}
    slices = -(-sum(lengths.values()) // slice_windows) or 1
    base = documents(docs, key, text)
    words = base.select("doc_id", row_key().alias("row"), normalised("text").alias("words"))
    words = _with_hashes(words)
    n = F.col("n_words")
    keys = [F.array(F.lit(0).cast("bigint"))]  # the row without a window
    at, length = F.lit(-1), F.lit(0)
    before = F.lit(1)
    for size in sorted(lengths):
        keys.append(_keys(n, size))
        inside = F.col("place") >= before
        at = F.when(inside, F.col("place") - before).otherwise(at)
        length = F.when(inside, F.lit(size)).otherwise(length)
        before = before + F.greatest(n - size + 1, F.lit(0))
    looked = (
        words.select("doc_id", "row", "words", "n_words", F.concat(*keys).alias("keys"))
        .select("doc_id", "row", "words", "n_words", F.posexplode_outer("keys").alias("place", "look"))
        .select("doc_id", "row", "words", "n_words", "look", at.alias("at"), length.alias("width"))
    )
    found = []
    for part in range(slices):
        table = windows if slices == 1 else windows.filter(
            F.pmod("key", F.lit(slices)) == part
        )
        joined = looked.join(  # about SLICE windows are broadcast
            F.broadcast(table), (F.col("look") == F.col("key")) & (F.col("width") == F.col("len")),
            "left",
        )
        whole = F.col("window").isNotNull() & (
            F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("width"))
            == F.col("window")
        )
        found.append(
            joined.filter(whole if part else whole | (F.col("at") < 0))
            .select("doc_id", "row", "n_words", "at", "width", "number")
        )
    hit = F.col("at") >= 0
    hits = materialise(reduce(DataFrame.union, found), "hits")
    rows = hits.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(~hit, 1)).alias("copies"),
        F.sort_array(F.collect_set(
            F.when(hit, F.struct(F.col("at").alias("start"), F.col("width").alias("len")))
        )).alias("found"),
    )
    # A row's windows, each once, and from there its items.
    numbers = of_items.join(windows, ["key", "len", "window"]).select("number", "item")
    listed = (
        hits.filter(hit).select("doc_id", "row", "number").distinct()
        .join(numbers, "number").filter("item is not null")
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    same = F.col("r.row").eqNullSafe(F.col("l.row")) & F.col("r.doc_id").eqNullSafe(F.col("l.doc_id"))
    return (
        rows.alias("r").join(listed.alias("l"), same, "left")
        .select(
            "r.doc_id", "r.row", F.col("n_words").cast("bigint").alias("n_words"), "copies",
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            _covered(F.col("found")).alias("spans"),
        )
        .select(
            "doc_id", "row", "n_words",
            F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
            .alias("n_hit"),
            "items", "spans", (F.size("spans") > 0).alias("contaminated"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", key: str = "doc_id",
    text: str = "text", **how,
) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) without the hit words
    and the separators before them.

    Clean rows come back as they are, null and empty texts and null ids too, and rows as
    often as they repeat. Other columns stay, whatever their names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    found = find_contamination(docs, items, key=key, text=text, **how).filter("contaminated")
    found = found.select("row", "spans").distinct()
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(key).cast("bigint"), F.col(text).cast("string")).alias("row"),
    )
    if remove == "documents":
        return whole.join(found, "row", "left_anti").select("doc.*")
    cut = whole.join(found, "row", "left").withColumns({
        "words": F.filter(F.split("text", _BETWEEN), lambda word: word != ""),
        "between": F.split("text", f"[^{_BETWEEN[1:-2]}]+", -1),
    })
    units = F.zip_with("between", "words", lambda before, word: F.concat(before, word))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.size("words")))

    def gap(units: Column, end: Column, i: Column) -> Column:
        start = F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
        return F.array_join(F.slice(units, start + 1, end - start), "")

    gaps = let(units, lambda u: F.transform(ends, lambda end, i: gap(u, end, i)))
    kept = F.concat(F.array_join(gaps, ""), F.element_at("between", -1))
    changed = F.when(F.col("spans").isNull(), F.col(f"doc.{text}")).otherwise(kept)
    return cut.select(*(
        changed.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns
    ))
