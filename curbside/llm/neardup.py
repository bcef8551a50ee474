"""Near-duplicate documents: MinHash with tensored banding, links verified on full sets.

Two collections of `tables` half keys (two minhashes each) stand for `tables` squared
hash tables: the key of table (i, j) is the pair of half keys A_i, B_j. 48 minhashes
serve 144 tables of four rows, which would otherwise take 576. Two documents of
similarity 0.8 share no table with a probability of about 1e-5.

The work stays near linear in copies:

* Equal sets are one class, represented by one text of its smallest id. Classes are numbered in
  the order of those ids, so the smallest number of a component has its smallest id.
* Half keys that one class alone has can't be part of a shared pair and go first, so
  pairs are only formed for classes that may have a partner.
* In a table's group only links to the group's smallest member are tested, never all
  pairs. What that leaves open (members of a group in different components) goes to an
  exact set-similarity join by prefixes: sets of similarity t share one of their rarest
  n - ceil(t n) + 1 shingles. Pairs within one component are not formed.

All intermediate results are written tables, so a lost executor repeats one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, materialise, row_key

_SKETCH = "doc_id bigint, row bigint, n bigint, fp1 bigint, fp2 bigint, half array<bigint>"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) pairs, distinct and sorted. A shorter text is one shingle;
    one without words has none."""
    tokens = tb.tokenise(texts, tb.SPACED, tb.LOWER)
    starts, counts = tb.window_starts(tokens, width)
    owners = [np.repeat(np.arange(len(tokens)), counts)]
    hashes = [tb.rolling(tokens.hashes, width)[starts]]
    for short in range(1, width):
        which = np.flatnonzero(tokens.counts == short)
        if len(which):
            owners.append(which)
            hashes.append(tb.rolling(tokens.hashes, short)[tokens.first[which]])
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    if len(tokens) <= 1 << 16:  # sorted by counting
        owner = owner.astype(np.uint16)
    owner, value = tb.distinct_within(owner, value)
    return owner.astype(np.int64), value


def _sketch(width: int, tables: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, 4 * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            owner, value = shingle_sets(block.column("text"), width)
            rows = len(block)
            n = np.bincount(owner, minlength=rows)
            some = np.flatnonzero(n)
            fps = np.zeros((2, rows), dtype=np.uint64)
            half = np.zeros((rows, 2 * tables), dtype=np.uint64)
            if len(some):
                cut = np.searchsorted(owner, some)
                fps[0, some] = np.add.reduceat(value, cut)
                fps[1, some] = np.add.reduceat(tb.mix(value), cut)
                low = [np.minimum.reduceat(value * f, cut) for f in factors]
                for slot in range(2 * tables):
                    first, second = low[2 * slot], low[2 * slot + 1]
                    half[some, slot] = tb.mix(
                        tb.mix(first + np.uint64(slot)) * np.uint64(3) + second
                    )
            limits = np.cumsum(np.append(0, np.where(n > 0, 2 * tables, 0)))
            keys = pa.array(half[some].view(np.int64).reshape(-1))
            yield pa.record_batch({
                "doc_id": block.column("doc_id"),
                "row": block.column("row"),
                "n": pa.array(n),
                "fp1": pa.array(fps[0].view(np.int64)),
                "fp2": pa.array(fps[1].view(np.int64)),
                "half": pa.ListArray.from_arrays(pa.array(limits, pa.int32()), keys),
            })

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in tb.blocks(iter([batch]), "text_a"):
                for block in tb.blocks(iter([half]), "text_b"):
                    rows = len(block)
                    left, x = shingle_sets(block.column("text_a"), width)
                    right, y = shingle_sets(block.column("text_b"), width)
                    owner, value = np.concatenate([left, right]), np.concatenate([x, y])
                    order = np.lexsort((value, owner))
                    owner, value = owner[order], value[order]
                    same = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
                    both = np.bincount(owner[1:][same], minlength=rows)
                    either = np.bincount(owner, minlength=rows) - both
                    linked = np.flatnonzero((100 * both >= percent * either) & (either > 0))
                    if len(linked):
                        yield block.select(["a", "b"]).take(pa.array(linked))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirm(width, percent), "a bigint, b bigint")
    )


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches.

    Alternating large and small stars, each round a written table; the driver sees one
    count and one checksum a round. Aggregates combine before they shuffle, and the
    joins on a hub's id can be split by adaptive execution.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(),
        name,
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = (
            both.join(least, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _shared(keys: DataFrame) -> DataFrame:
    """The rows (key, rep) whose key more than one class has, with the smallest."""
    groups = keys.groupBy("key").agg(
        F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("m")
    )
    return keys.join(groups.filter("hub < last").drop("last"), "key")


def _explode_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            owner, value = shingle_sets(block.column("text"), width)
            yield pa.record_batch({
                "rep": block.column("rep").take(pa.array(owner)),
                "n": pa.array(np.bincount(owner, minlength=len(block))[owner]),
                "key": pa.array(value.view(np.int64)),
            })

    return run


def _open_pairs(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `open_` (rep, root) of different roots that may be similar
    enough: an exact prefix join with size and position bounds."""
    sets = texts.join(open_.select("rep"), "rep", "left_semi").select("rep", "text")
    shingles = sets.mapInArrow(_explode_sets(width), "rep bigint, n bigint, key bigint")
    frequency = shingles.groupBy("key").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("rep").orderBy("df", "key")
    prefix = (
        shingles.join(frequency, "key")
        .withColumn("at", F.row_number().over(rarest))
        .join(open_, "rep")
        .filter(F.expr(f"df > 1 and at <= n - ceil({percent} * n / 100) + 1"))
    )
    prefix = materialise(prefix.select("key", "rep", "n", "root", "at"), "prefixes")
    sides = [prefix.select(*(F.col(c).alias(f"{c}_{x}") for c in prefix.columns)) for x in "ab"]
    overlap = f"{100 + percent} * (1 + least(n_a - at_a, n_b - at_b)) >= {percent} * (n_a + n_b)"
    sizes = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    return (
        sides[0].join(sides[1], F.expr("key_a = key_b and rep_a < rep_b and root_a <> root_b")
                      & F.expr(sizes) & F.expr(overlap))
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    tables: int = 12,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, row (a hash of id and text).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set is the distinct
    shingles of `width` words, or the whole sequence of a shorter text. Documents are
    linked if 100 * intersection >= percent * union. component_id is the smallest id
    reachable; kept marks the document that has it. Null, empty and blank texts have
    empty sets and are linked with nothing. Rows that repeat an id are one document: what
    any of their texts is linked with, all of them are. Rows with a null id are linked with
    nothing, have a null component_id and are kept. Other columns are not looked at.
    """
    base = documents(docs, key, text).withColumn("row", row_key())
    sketches = materialise(
        base.filter(F.col("doc_id").isNotNull()).mapInArrow(_sketch(width, tables), _SKETCH),
        "sketches",
    )
    some = sketches.filter("n > 0")
    same = ["fp1", "fp2", "n"]
    # A table of its own, so that both sides of the join are plain shuffles: adaptive
    # execution then splits a class that holds a large part of the rows. `rep` is the class.
    firsts = materialise(
        some.groupBy(*same)
        .agg(F.min("doc_id").alias("first"), F.min_by("row", "doc_id").alias("first_row"))
        .orderBy("first", *same).withColumn("rep", F.monotonically_increasing_id()),
        "firsts",
    )
    classes = materialise(
        some.join(firsts, same).select("doc_id", "row", "n", "rep", "half", "first", "first_row"),
        "classes",
    )
    reps = classes.filter("doc_id = first and row = first_row")
    # Ids that several texts share tie the texts' classes together.
    twice = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
    ties = classes.join(twice.filter("a < last"), "doc_id").filter("rep > a").select(
        "a", F.col("rep").alias("b")
    ).distinct()

    halves = reps.select("rep", F.posexplode("half").alias("slot", "key"))
    shared = _shared(halves).groupBy("rep").agg(
        F.collect_list(F.when(F.col("slot") < tables, F.col("key"))).alias("a"),
        F.collect_list(F.when(F.col("slot") >= tables, F.col("key"))).alias("b"),
    )
    tensored = shared.select("rep", F.explode(F.flatten(F.transform(
        "a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))
    ))).alias("key")).distinct()
    buckets = materialise(_shared(tensored), "buckets")
    members = buckets.select("rep").distinct().join(firsts, "rep").select(
        "rep", F.col("first").alias("doc_id"), F.col("first_row").alias("row")
    )
    texts = materialise(
        base.filter("text is not null").join(members, ["doc_id", "row"])
        .groupBy("rep").agg(F.min_by("text", F.xxhash64("text")).alias("text")),
        "texts",
    )

    hubs = buckets.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    hubs = hubs.distinct()
    links = materialise(
        _confirmed(hubs, texts, width, percent).union(ties), "hub_links"
    )
    roots = components(links, "hub_components")
    placed = buckets.filter("m > 2").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
    open_ = materialise(
        placed.join(mixed.filter("x < y"), "key").select("rep", "root").distinct(), "open"
    )
    rest = _open_pairs(open_, texts, width, percent).join(hubs, ["a", "b"], "left_anti")
    found = materialise(_confirmed(rest, texts, width, percent).union(links), "links")
    roots = components(found, "components")

    lowest = firsts.select(F.col("rep").alias("root"), F.col("first").alias("component_id"))
    known = (
        classes.select("doc_id", "row", "n", "rep")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "row", "n", F.coalesce("root", "rep").alias("root"))
        .join(lowest, "root").select("doc_id", "row", "n", "component_id")
    )
    empty = sketches.filter("n = 0").select(
        "doc_id", "row", "n", F.col("doc_id").alias("component_id")
    )
    lost = base.filter(F.col("doc_id").isNull()).mapInArrow(_sketch(width, 1), _SKETCH).select(
        "doc_id", "row", "n", F.lit(None).cast("bigint").alias("component_id")
    )
    return known.union(empty).union(lost).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "row",
    )
