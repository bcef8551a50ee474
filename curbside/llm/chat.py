"""Chat formatting by columnar byte assembly.

A block of turns becomes one preallocated buffer: segment lengths, their cumulative
offsets and the places to copy to are numpy arrays, headers and contents are scattered
into the buffer, and Arrow strings are laid over it, one per conversation.

Turns are `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside a text get a
backslash behind their first character, and one more if they have some already, so a
formatted text has control strings only where the template put them, and taking one
backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb

START, END = "<|im_start|>", "<|im_end|>"
_FOOTER = f"{END}\n"
#: Strings that a text must not bring along: the template's own, and those of others.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: The places between the first character and the rest of a control string.
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
_unescape = re.compile(_UNESCAPE)

_SCHEMA = (
    "conv_id bigint, part int, n_turns bigint, text string, "
    "loss array<struct<start: bigint, end: bigint>>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(texts: pa.Array) -> pa.Array:
    """Reversibly without control strings."""
    once = pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")
    return once


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2\3", text)


def _header(role: str) -> bytes:
    plain = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{escape(pa.array([plain]))[0].as_py()}\n".encode()


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


def assemble(
    roles: pa.Array, texts: pa.Array, first: np.ndarray, trained: str
) -> tuple[pa.Array, pa.Array]:
    """Formatted strings and their loss spans. Turns `first[i]:first[i + 1]` are the i-th."""
    roles = roles.dictionary_encode()
    kinds = roles.dictionary.to_pylist()
    role = roles.indices.to_numpy().astype(np.int64)
    headers = [_header(kind) for kind in kinds]
    table = np.frombuffer(b"".join(headers) or b"\0", dtype=np.uint8)
    sizes = np.array([len(h) for h in headers], dtype=np.int64)
    data, limits = tb.text_bytes(escape(texts))
    footer = np.frombuffer(_FOOTER.encode(), dtype=np.uint8)

    head = sizes[role]
    body = np.diff(limits)
    length = head + body + len(footer)
    end = np.cumsum(length)
    start = end - length
    out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    out[tb.ranges(start, head)] = table[tb.ranges((np.cumsum(sizes) - sizes)[role], head)]
    out[tb.ranges(start + head, body)] = data
    out[(end - len(footer))[:, None] + np.arange(len(footer))] = footer

    offsets = np.append(start, len(out))[first]
    strings = pa.LargeStringArray.from_buffers(
        len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)
    )
    points = np.append(0, np.cumsum((out & 0xC0) != 0x80))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    learn = np.isin(role, [i for i, kind in enumerate(kinds) if kind == trained])
    base = points[offsets[:-1]][row[learn]]
    spans = pa.StructArray.from_arrays(
        [pa.array(points[(start + head)[learn]] - base),
         pa.array(points[(start + head + body)[learn]] - base)],
        names=["start", "end"],
    )
    counts = np.bincount(row[learn], minlength=len(first) - 1)
    limits = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return strings.cast(pa.string()), pa.ListArray.from_arrays(limits, spans).cast(_SPANS)


def _format(trained: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        conv, part = None, 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal conv, part
            batch = table.combine_chunks().to_batches()[0]
            ids = batch.column("conv_id").to_pylist()
            first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            parts = np.zeros(len(first) - 1, dtype=np.int32)
            if conv == (ids[0],):
                parts[0] = part
            conv, part = (ids[-1],), int(parts[-1]) + 1
            first = np.array(first)
            text, loss = assemble(batch.column("role"), batch.column("text"), first, trained)
            return pa.record_batch({
                "conv_id": batch.column("conv_id").take(pa.array(first[:-1])),
                "part": pa.array(parts),
                "n_turns": pa.array(np.diff(first)),
                "text": text,
                "loss": loss,
            })

        for block in tb.blocks(batches, size=size):
            table = pa.Table.from_batches([block])
            held = table if held is None else pa.concat_tables([held, table])
            ids = held.column("conv_id").to_pylist()
            at = len(ids) - 1  # the last conversation may go on
            while at and ids[at - 1] == ids[-1]:
                at -= 1
            if at:
                yield emit(held.slice(0, at))
                held = held.slice(at)
            if pc.sum(pc.binary_length(held.column("text"))).as_py() > size:
                yield emit(held)
                held = None
        if held is not None and held.num_rows:
            yield emit(held)

    return run


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def format_chats(
    turns: DataFrame, trained: str = "assistant", part_bytes: int = tb.BLOCK_BYTES
) -> DataFrame:
    """Per conversation: conv_id, part, n_turns, text, loss (spans of `text` in code points
    to train on: the texts of role `trained`, without header and end).

    Turns are ordered by turn, role and text. A conversation of more than `part_bytes`
    comes in several rows, numbered by part; its text is their concatenation, so one of
    any size streams through. Null roles and texts are empty; rows without turn come
    first, those without conv_id are one conversation. Repeated rows are turns like any
    other. Other columns are not looked at.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), _text("role"), _text("text")
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_format(trained, part_bytes), _SCHEMA)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None

    def done() -> pa.RecordBatch:
        return pa.record_batch({
            "conv_id": pa.array([state["conv"]], pa.int64()),
            "n_turns": pa.array([state["turns"]]),
            "turns_sha256": pa.array([state["all"].hexdigest()]),
            "loss_chars": pa.array([state["chars"]]),
            "loss_sha256": pa.array([state["loss"].hexdigest()]),
            "formatted_chars": pa.array([state["size"]]),
        })

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or state["conv"] != row["conv_id"]:
                if state is not None:
                    yield done()
                state = {"conv": row["conv_id"], "turns": 0, "chars": 0, "size": 0,
                         "all": hashlib.sha256(), "loss": hashlib.sha256()}
            for role, text in parse(row["text"]):
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(row["text"][span["start"] : span["end"]])
                state["chars"] += len(text)
                state["loss"].update(text.encode())
            state["size"] += len(row["text"])
    if state is not None:
        yield done()


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    out = []
    for turn in text.split(_FOOTER)[:-1]:
        header, _, body = turn.removeprefix(START).partition("\n")
        out.append((_role(header), unescape(body)))
    return out


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation, parsed back from formatted rows: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Parts stream through one after the other."""
    return (
        chats.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .select("conv_id", "text", "loss")
        .mapInArrow(
            _digest,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
            "loss_sha256 string, formatted_chars bigint",
        )
    )
