"""The audit of filters against counting every order by hand."""

import itertools
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    # Names the operator uses for columns of its own.
    T.StructField("part", T.StringType()),
    T.StructField("words", T.StringType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("good", T.StringType()),
])
LABELS = "doc_id long, quality int, toxic int, first string"

LONG = " ".join(f"word{i}" for i in range(250))
ODD = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (2, LONG, "b"), (1, LONG, None),
    (4, None, "a"), (5, "", "a"), (6, "", None), (None, LONG, "a"), (None, None, ""),
    (7, "same " * 300, "b"), (8, LONG + " #", "b"), (9, LONG.upper(), "c"),
    (10, "ONE $ " * 150, "c"), (11, "ÄÖÜ 日本語 " * 120, "b"), (12, LONG + "\x85| x", "c"),
    (13, "word " * 50_000, "a"), (13, "other text of the same id", "a"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, 1)]


def by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, source in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = "".join(name for name, failed in {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }.items() if failed)
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                shares[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in d[0] for d in docs) - len(gone),
                    sum(d[0] == name for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def found(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_odd_documents(spark):
    docs = spark.createDataFrame([(i, t, s, "p", "w", 1, "g") for i, t, s in ODD], SCHEMA)
    labels = spark.createDataFrame([(*m, "f") for m in MARKS], LABELS)
    assert found(audit.audit_documents(docs, labels)) == by_hand(ODD, MARKS)


def test_given_documents(table):
    docs, labels = table("documents"), table("labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert found(audit.audit_documents(docs, labels)) == by_hand(rows, marks)


def test_no_documents(spark, table):
    docs = spark.createDataFrame([], SCHEMA)
    assert audit.audit_documents(docs, spark.createDataFrame([], LABELS)).count() == 0
    assert found(audit.audit_documents(table("documents"), spark.createDataFrame([], LABELS)))


@pytest.mark.parametrize("n", range(1, 7))
def test_every_order_is_seen_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for level in audit.swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_swaps_keep_the_counts_and_stay_reduced():
    masks = {m: ((m * 7 + 3) % 5, m % 2) for m in range(16) if m % 3}
    diagram = audit.Diagram(masks, 4)
    for level in audit.swaps(4):
        diagram.swap(level)
        fresh = {}
        for mask, counts in masks.items():  # bits in the present order
            fresh[sum(1 << at for at, i in enumerate(diagram.order) if mask >> i & 1)] = counts
        anew = audit.Diagram(fresh, 4)
        assert [len(level) for level in diagram.levels] == [len(level) for level in anew.levels]
        assert [s[1:] for s in diagram.steps()] == [s[1:] for s in anew.steps()]
        assert [diagram.order[i] for i, _, _ in anew.steps()] == [i for i, _, _ in diagram.steps()]


def test_other_filters(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("mask"), "id")
    two = audit.audit(rows, {"x": F.col("mask") == 1, "y": F.col("id") < 500}, F.lit(None), {})
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in two.collect()}
    low, ones = 500, sum(i % 7 == 1 for i in range(1000))
    both = sum(i % 7 == 1 for i in range(500))
    end = 1000 - low - ones + both
    assert got == {("xy", 1): (1000 - ones, ones), ("xy", 2): (end, low - both),
                   ("yx", 1): (500, 500), ("yx", 2): (end, ones - both)}
    with pytest.raises(ValueError, match="one letter"):
        audit.audit(rows, {"xy": F.lit(True)}, F.lit(""), {})
