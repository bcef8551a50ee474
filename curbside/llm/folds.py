"""Sequential folds over the arrays of one row, with DataFrame functions only.

An aggregate that appends to an array copies it at every step. Here items are folded in
stretches of about the root of their number: a step copies one short stretch, and only a
finished stretch is appended to the whole, so n items cost about n * sqrt(n) cheap copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of text.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it: a column that is
    used once, but inside a lambda, would be computed there for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(
    items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]
) -> Column:
    """Struct of `carry` and `all`. `step` gives the new carry and what to append to `all`
    (nothing, if null; else of type `kind`) from the old carry and an item."""
    return let(items, lambda bound: _fold(bound, start, kind, step))


def _fold(items, start, kind, step):
    none = F.array().cast(f"array<{kind}>")
    size = F.greatest(F.size(items), F.lit(0))
    # The same for all stretches of a row, and cheap enough to be computed for each.
    stretch = F.greatest(F.lit(16), F.ceil(F.sqrt(size)).cast("int"))

    def inner(state: Column, item: Column) -> Column:
        carry, new = step(state["carry"], item)
        return F.struct(
            carry.alias("carry"),
            F.when(new.isNull(), state["all"]).otherwise(F.array_append(state["all"], new)).alias("all"),
        )

    def outer(state: Column, at: Column) -> Column:
        part = F.aggregate(
            F.slice(items, at, stretch),
            F.struct(state["carry"].alias("carry"), none.alias("all")), inner,
        )
        return let(part, lambda p: F.struct(
            p["carry"].alias("carry"), F.array_append(state["all"], p["all"]).alias("all")
        ))

    begins = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)), stretch)).otherwise(
        F.array().cast("array<int>")
    )
    lists = F.array().cast(f"array<array<{kind}>>")
    whole = F.aggregate(begins, F.struct(start.alias("carry"), lists.alias("all")), outer)
    return let(whole, lambda w: F.struct(
        w["carry"].alias("carry"), F.flatten(w["all"]).alias("all")
    ))


def places(parts: Column) -> Column:
    """Start of each part in code points."""
    return fold(
        parts, F.lit(0), "int", lambda at, part: (at + F.length(part), at)
    )["all"]


def text_blocks(text: Column) -> Column:
    """The text in blocks of `BLOCK` code points, for `piece`. One pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points `start` to `end` of a text, from its blocks: at the cost of the piece, not
    of its place."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    at = start % BLOCK + 1
    head = F.substring(F.get(blocks, first), at, F.lit(BLOCK))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.get(blocks, last), F.lit(1), end - last * BLOCK)
    inside = F.substring(F.get(blocks, first), at, end - start)
    return F.when(end <= start, "").when(first == last, inside).otherwise(
        F.concat(head, middle, tail)
    )
