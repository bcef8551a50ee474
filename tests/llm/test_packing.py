"""Packing against the library's own encoding and the rules of the sequences."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curbside.llm import packing, queries

from .conftest import ODD, documents

MORE = [
    "Don't I'LL we've'd 'S 's'5's ...'s !'re 'tis it'S5's x' ' '' '''s",
    "<|startoftext|> a <|ENDOFTEXT|> <|endoftext|>b",
    "5½ 5́á≠≮x é ́a KK İstanbul ΟΔΥΣΣΕΥΣ ΟΔΥΣΣΕΥΣ.",
    "a\x00b\x1c\x1d'\x1es\x7f\x85t u v　w",
    "한국어 각 각 1٣٤5",
]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def ids_of(library, text, end=1):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def check(df, rows, library, window, tail=None):
    """Each document whole in its pieces, each sequence whole in its own."""
    found = df.collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.tokens) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, dtype="<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    wanted = collections.defaultdict(collections.Counter)
    for doc, text in rows:
        wanted[doc][tuple(ids_of(library, text))] += 1
    for doc, texts in wanted.items():
        tokens = collections.Counter(t for ids, k in texts.items() for t in ids * k)
        assert tokens == collections.Counter(t for r in docs[doc] for t in r.tokens)
        if texts.total() == 1:
            (ids,) = texts
            at = 0
            for r in sorted(docs[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert tuple(r.tokens) == ids[at : at + r.length]
                at += r.length
            assert at == len(ids)
    assert set(docs) == set(wanted)


@pytest.mark.parametrize("window", [16, 2048])
def test_odd_documents(spark, odd_documents, vocabulary, library, window):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    df = packing.pack_documents(
        odd_documents, vocabulary("word_bpe_49k.json"), window=window, open_windows=3
    )
    check(df, rows, library, window)


def test_given_documents(spark, table, vocabulary, library):
    docs = table("documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(packing.pack_documents(docs, vocabulary("word_bpe_49k.json")), rows, library, 2048)


def test_other_tokenizer_gets_whole_texts(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(ODD[:12])]
    path = vocabulary("byte_bpe_50k.json")
    df = packing.pack_documents(documents(spark, rows), path, window=64)
    check(df, rows, Tokenizer.from_file(path), 64)


def test_no_documents(spark, no_documents, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    assert packing.pack_documents(no_documents, path).count() == 0
    assert packing.pack_documents(documents(spark, [(1, "")]), path, end=None).count() == 0


def test_query(spark, sf_small, library):
    """The registered query's own columns."""
    got = queries.op12_packing(spark, sf_small)
    assert "tokens" not in got.columns
    texts = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array(ids_of(library, r.text), dtype="<u4") for r in texts}
    total = 0
    for r in got.collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes())) == (r.length, r.ids_crc32)
        assert r.doc_tokens == len(ids[r.doc_id])
        total += r.length
    assert total == sum(map(len, ids.values()))


def alone(vocabulary_path, texts):
    import pyarrow as pa

    ids, limits = packing._encoder(vocabulary_path)(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)]


def test_words_alone_give_the_ids_of_the_text(vocabulary, library):
    path = vocabulary("word_bpe_49k.json")
    assert packing._encoder(path).by_piece
    texts = ODD + MORE
    assert alone(path, texts) == [ids_of(library, t)[:-1] for t in texts]


def test_the_word_between_others_as_a_word(vocabulary, library):
    path = vocabulary("word_bpe_49k.json")
    word = packing._encoder(path).between.strip()
    texts = [f"{word} x", f"a {word}{word} b9{word.upper()}", " ".join(f"w{i}q" for i in range(700)), word]
    assert alone(path, texts) == [ids_of(library, t)[:-1] for t in texts]


PARTS = st.sampled_from(
    ["'", "s", "'s", "T", "re", "5", ".", "-", " ", "\n", "\x0b", "\x1c", "́", "̸", "é",
     "E", "K", "K", "½", "٣", "日", "\x85", " ", "İ", "Σ", "=", "<", "|", "ᄀ", "ᅡ"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=4))
def test_made_up_texts(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing._encoder(path).tokenizer
    wanted = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert alone(path, texts) == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 16), st.integers(1, 5))
def test_packer(sizes, window, places):
    packer = packing.Packer(window, places)
    for i, n in enumerate(sizes):
        packer.add([(i, 0, np.arange(n), n)])
        assert len(packer.room) <= places
    assert all(sum(len(p[2]) for p in w) < window for w in packer.held.values())
    packer.finish()
    rows = packer.take()
    got, lengths = collections.defaultdict(list), collections.Counter()
    for (doc, start, ids, total), sequence, offset in rows:
        assert ids.tolist() == list(range(start, start + len(ids))) and total == sizes[doc]
        got[doc] += ids.tolist()
        assert offset == lengths[sequence]
        lengths[sequence] += len(ids)
    assert {d: sorted(x) for d, x in got.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    short = [n for n in lengths.values() if n < window]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
