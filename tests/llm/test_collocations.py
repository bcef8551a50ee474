"""Collocations against counting by hand; automata against dictionaries."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from curbside.llm import automata, collocations

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def by_hand(rows, least=30, width=4, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(width, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in candidates.items():
            around = [
                n for longer, n in candidates.items() if len(longer) > len(p)
                and any(longer[i : i + len(p)] == p for i in range(len(longer) - len(p) + 1))
            ]
            if any(100 * n >= 80 * a for n in around):
                continue
            score, _, l, r = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                for k in range(1, len(p))
            )
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, l, r, score))
        for rank, (_, _, _, phrase, a, l, r, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, a, l, r, sizes[lang], score))
    return out


def found(df):
    return sorted(tuple(r) for r in df.collect())


SCHEMA = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("text", T.StringType()),
    # Names the operator uses for columns of its own.
    *(T.StructField(n, T.StringType()) for n in ("key", "n", "h1", "range", "sample", "rank")),
])


def docs_of(spark, rows):
    return spark.createDataFrame([(lang, t, *"knhrsr") for lang, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(3)
    words = ["the", "THE", "cat", "Äpfel", "äpfel", "日本", "\x85", "x'y", "of", "a b", "1", "|"]
    marks = [" ", "  ", "\t", ". ", "\n", ", ", "\x0b", "? "]
    rows = []
    for lang in ("en", "de", None, "und", "", "en"):
        for _ in range(30):
            n = int(rng.integers(0, 60))
            picks = rng.zipf(1.5, n) % len(words)
            rows.append((lang, "".join(words[w] + marks[rng.integers(0, 8) if rng.random() < 0.3 else 0]
                                       for w in picks)))
    rows += [("en", None), (None, None), ("xx", ""), ("yy", " \t\n,"), ("zz", "one word"),
             ("aa", "la " * 3000), ("aa", "b" * 20_000), ("bb", "to be or not " * 700)]
    return rows


@pytest.mark.parametrize(
    "settings_", [{}, {"shard": 50, "size": 8, "sampled": 1}, {"shard": 700, "size": 100, "sampled": 3}]
)
def test_odd_documents(spark, odd_rows, settings_):
    """One range; more ranges than words, whose limits cut words, pairs and triples."""
    df = collocations.collocations(docs_of(spark, odd_rows).repartition(5), least=5, **settings_)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = found(df)
    assert got == sorted(by_hand(odd_rows, 5)) and len(got) > 50


@pytest.mark.parametrize("width", [2, 3, 5])
def test_other_widths_and_ties_at_the_end(spark, odd_rows, width):
    df = collocations.collocations(
        docs_of(spark, odd_rows), least=3, width=width, top=7, size=64, sampled=1
    )
    assert found(df) == sorted(by_hand(odd_rows, 3, width, 7))


@pytest.mark.parametrize("size", [8, 10**6])
def test_more_frequent_words_than_are_numbered(spark, odd_rows, monkeypatch, size):
    monkeypatch.setattr(collocations, "NUMBERED", 3)
    df = collocations.collocations(docs_of(spark, odd_rows), least=5, size=size, sampled=1)
    assert found(df) == sorted(by_hand(odd_rows, 5))


def test_many_questions_are_dealt_out(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(collocations, "_ASKED", 10)
    df = collocations.collocations(docs_of(spark, odd_rows), least=5)
    assert found(df) == sorted(by_hand(odd_rows, 5))


def test_given_documents(spark, table):
    docs = table("documents")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert found(collocations.collocations(docs)) == sorted(by_hand(rows))
    df = collocations.collocations(docs, least=4, shard=5000, size=2000, sampled=16)
    assert found(df) == sorted(by_hand(rows, 4))


def test_no_documents(spark):
    assert found(collocations.collocations(docs_of(spark, []))) == []
    assert found(collocations.collocations(docs_of(spark, [("en", None), ("en", "a b")]))) == []


def test_counts_beyond_64_bits(spark):
    """Products that no long holds."""
    from pyspark.sql import functions as F

    n = 9 * 10**17
    row = spark.createDataFrame([(n, n + 1, n)], "a long, l long, r long")
    score = collocations._score(F.col("l"), F.col("r"), F.col("a"), 2_000_000)
    assert row.select(score).first()[0] == 2_000_000 * n // (2 * n + 1)


# ------------------------------------------------------------------ automata

ROWS = st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=80)


def windows(lists, width=4):
    out = np.zeros((len(lists), width), dtype=np.uint64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = np.array(row, dtype=np.uint64) << np.uint64(60)
    return out


def built(lists):
    keys, ranks = automata.ranked(windows(lists))
    rows, counts = automata.summed(ranks, np.ones(len(ranks), dtype=np.int64))
    return keys, rows, counts, automata.Transducer.build(keys, rows, counts)


@settings(max_examples=200, deadline=None)
@given(ROWS, ROWS)
def test_transducers(first, second):
    keys, rows, counts, one = built(first)
    again = automata.Transducer.decode(one.encode())
    assert [a.tolist() for a in again.rows()] == [rows.tolist(), counts.tolist()]
    for arcs in one.levels[1:]:  # no two states alike
        states = [
            (arcs.label[a:b].tolist(), arcs.weight[a:b].tolist(), arcs.target[a:b].tolist())
            for a, b in zip(arcs.first[1:-1], arcs.first[2:], strict=True)
        ]
        assert len(states) == len({repr(s) for s in states}) and all(s[0] for s in states)
    both = automata.union([one, built(second)[3], one])
    wanted = collections.Counter(map(tuple, first * 2 + second))
    got, sums = both.rows()
    got = [tuple((both.keys[r[r > 0]] >> np.uint64(60)).tolist()) for r in got]
    assert dict(zip(got, sums.tolist(), strict=True)) == wanted and got == sorted(got)
    asked_keys, ranks = automata.ranked(windows(second))
    asked, which = automata.distinct(ranks)
    counted = one.compose(asked_keys, asked)[which].tolist()
    assert counted == [sum(w[: len(q)] == q for w in first) for q in second]
