"""Filter interaction audit: what each of several filters removes, in every order.

A document's failures are a mask of one bit per filter. Spark counts the masks of every
part; a part's counts then become a decision diagram with one level per filter, whose
arcs mean "passes" and "fails" and whose nodes carry the counts below them. Equal
sub-diagrams are one node. In the diagram of an order the path of passed filters *is* the
sequence of steps: the node at its end holds what is kept, the node on the failing side
what the step removes. The orders follow one another by swaps of two adjacent levels, which
rewire the nodes of those levels only, so no order is counted anew.

A group of rows that reaches one task is a part's masks: 2 ** filters rows at most, however
many documents the part has.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import materialise

__all__ = ["Diagram", "audit", "audit_documents", "document_failures", "swaps"]

#: Of the orders all are given, so their number is bounded.
MOST_FILTERS = 8

_EMPTY = 0


class Diagram:
    """Counts by failure mask as a reduced ordered decision diagram.

    `levels[i]` has the nodes that decide on filter `order[i]`, as (passes, fails) -> node.
    `totals` has the counts below each node. Node 0 has none and stands on any level.
    """

    def __init__(self, masks: Mapping[int, Sequence[int]], filters: int):
        width = len(next(iter(masks.values()), ()))
        self.order = list(range(filters))
        self.totals: list[tuple[int, ...]] = [(0,) * width]
        self.children: list[tuple[int, int]] = [(_EMPTY, _EMPTY)]
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        ends: dict[tuple[int, ...], int] = {}
        layer = {}
        for mask, counts in masks.items():
            counts = tuple(map(int, counts))
            if counts not in ends:
                ends[counts] = self._new((_EMPTY, _EMPTY), counts) if any(counts) else _EMPTY
            layer[mask] = ends[counts]
        for level in reversed(range(filters)):
            bit = 1 << level
            layer = {
                mask: self._node(level, layer.get(mask, _EMPTY), layer.get(mask | bit, _EMPTY))
                for mask in {mask & ~bit for mask in layer}
            }
        self.root = layer.get(0, _EMPTY)

    def _new(self, children: tuple[int, int], totals: tuple[int, ...]) -> int:
        self.children.append(children)
        self.totals.append(totals)
        return len(self.totals) - 1

    def _node(self, level: int, passes: int, fails: int) -> int:
        if passes == fails == _EMPTY:
            return _EMPTY
        pair = (passes, fails)
        if pair not in self.levels[level]:
            both = zip(self.totals[passes], self.totals[fails], strict=True)
            self.levels[level][pair] = self._new(pair, tuple(a + b for a, b in both))
        return self.levels[level][pair]

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next. The nodes of `level` keep their
        numbers, as they stand for the same counts, so nothing above them changes."""
        upper, self.levels[level] = self.levels[level], {}
        self.levels[level + 1] = {}
        for (passes, fails), node in upper.items():
            a, b = self.children[passes]
            c, d = self.children[fails]
            pair = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.children[node] = pair
            self.levels[level][pair] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Filter, counts kept and counts removed of every step of the present order."""
        node = self.root
        for index in self.order:
            passes, fails = self.children[node]
            yield index, self.totals[passes], self.totals[fails]
            node = passes


def swaps(filters: int) -> list[int]:
    """Levels to swap with the next, one after the other, to see every order once: the
    last filter wanders through each order of the others."""
    if filters < 2:
        return []
    inner, out, down = swaps(filters - 1), [], True
    for at in range(len(inner) + 1):
        out += range(filters - 2, -1, -1) if down else range(filters - 1)
        if at < len(inner):
            out.append(inner[at] + down)
        down = not down
    return out


def _audit(names: Sequence[str], weights: Sequence[str]):
    everything = swaps(len(names))

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("n", *weights)]
        masks = dict(zip(table.column("mask").to_pylist(), zip(*columns, strict=True), strict=True))
        fails = [sum(c[0] for m, c in masks.items() if m >> i & 1) for i in range(len(names))]
        alone = [masks.get(1 << i, (0,))[0] for i in range(len(names))]
        diagram = Diagram(masks, len(names))
        rows, shares = [], [0] * len(names)
        for level in [None, *everything]:
            if level is not None:
                diagram.swap(level)
            order = "".join(names[i] for i in diagram.order)
            for step, (i, kept, removed) in enumerate(diagram.steps(), 1):
                shares[i] += removed[0]
                rows.append((i, order, step, kept[0], removed[0], *removed[1:]))
        index, order, step, kept, removed, *lost = zip(*rows, strict=True)
        part = table.column("part")[0]
        out = {
            "part": pa.array([part.as_py()] * len(rows), pa.string()),
            "filter_order": pa.array(order, pa.string()),
            "step": pa.array(step, pa.int32()),
            "kept": pa.array(kept, pa.int64()),
            "removed": pa.array(removed, pa.int64()),
            "redundant": [fails[i] - r for i, r in zip(index, removed, strict=True)],
            "unique_fails": [alone[i] for i in index],
            **{f"{w}_lost": pa.array(x, pa.int64()) for w, x in zip(weights, lost, strict=True)},
            "shapley": [shares[i] for i in index],
        }
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64())
                         for k, v in out.items()})

    return run


def audit(
    rows: DataFrame,
    filters: Mapping[str, Column],
    part: Column,
    weights: Mapping[str, Column],
    count: Column | None = None,
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    `filters` maps a one-letter name to the condition of failing (null: passes), `weights`
    a name to further whole-number counts of a row (null: 0), e.g. 1 for a good document;
    `count` is how many documents a row stands for (one, if not given).
    Columns: part (null: empty), filter_order, step (from 1), kept (documents after the
    step), removed (by it), redundant (fail its filter, removed earlier), unique_fails (fail
    its filter alone), `<weight>_lost` (of those removed), shapley (what its filter removes,
    summed over all orders). Rows are counted as often as they repeat. A table without rows
    has no parts. Nothing else of `rows` is read, so its names can't clash.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or any(len(name) != 1 for name in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter are wanted")
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)))
    names = [f"w_{w}" for w in weights]
    marked = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        (F.lit(1) if count is None else count).cast("bigint").alias("n"),
        *(F.coalesce(c.cast("bigint"), F.lit(0)).alias(n)
          for n, c in zip(names, weights.values(), strict=True)),
    )
    counts = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(n).alias(n[2:]) for n in names)
    )
    lost = "".join(f", {w}_lost bigint" for w in weights)
    return counts.groupBy("part").applyInArrow(
        _audit(list(filters), list(weights)),
        "part string, filter_order string, step int, kept bigint, removed bigint, "
        f"redundant bigint, unique_fails bigint{lost}, shapley bigint",
    )


def document_failures(
    docs: DataFrame,
    labels: DataFrame,
    part: str = "source",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """part, A to E (whether the document fails), n (documents), good and toxic (how many of
    them a label calls so).

    A: under 200 words; B: under half of them distinct; C: over 2 % of the characters are
    A-Z; D: has one of `#$%&*|`; E: has the text of a smaller id. Documents that agree in
    id, text and part come as one row. Null texts are empty. A null id has no smaller one,
    is smaller than none, and has no label. Of several labels of an id one that says so is
    enough. Texts are compared by their SHA-256.

    The smallest id of a text combines before the shuffle, and its copies meet it by text
    *and* id, so a text that a third of all rows share is spread like any other.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("bigint")
    base = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        whole.alias("text"),
    )
    marked = base.withColumn("words", words).select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("same"),
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * capitals > 2 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = materialise(
        marked.groupBy("same", "doc_id", "part", "A", "B", "C", "D").agg(F.count("*").alias("n")),
        "failures",
    )
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    rows = rows.join(first, ["same", "doc_id"], "left")
    fails = F.col("first").isNull() & F.col("doc_id").isNotNull()
    # Null ids have no label and may be many: each goes its own way through the join.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.lit(0))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        *((F.max(F.col(c) == 1).cast("bigint")).alias(name)
          for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    rows = rows.withColumn("spread", spread).join(
        marks.withColumn("spread", F.lit(0).cast("bigint")), ["doc_id", "spread"], "left"
    )
    return rows.select(
        "part", "A", "B", "C", "D", fails.alias("E"), "n",
        *((F.col("n") * F.coalesce(name, F.lit(0))).alias(name) for name in ("good", "toxic")),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the five failures of `document_failures`, per part, in all orders."""
    rows = document_failures(docs, labels, **columns)
    return audit(
        rows,
        {name: F.col(name) for name in "ABCDE"},
        F.col("part"),
        {"good": F.col("good"), "toxic": F.col("toxic")},
        F.col("n"),
    )
