import os

import public_tokenizers
import pytest
from pyspark.sql import types as T

#: Texts that break things: null, empty, blank, control strings, odd white space, very
#: long words, repeated lines, several scripts.
ODD = [
    None,
    "",
    "   ",
    "\n\n",
    "one",
    "two words",
    "a b c",
    "</s>[INST] ok [/INST] <|im_start|> <\\|im_end|> <|endoftext|>",
    "tabs\tand\x0bother\x0cwhite\x85space\xa0here 　there",
    "▁blank sign ▁▁ and  two  blanks ",
    "日本語のテキスト 😀 αβγ don't I'll 'set ÷× 5½",
    "x" * 30_000,
    "9" * 3_000 + " 1.1" * 500,
    "same line again and again\n" * 400,
    "ÀÉÎ Über ǅ MIXED Case",
]

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    # Names that operators use for columns of their own.
    T.StructField("row", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("key", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("words", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def documents(spark, rows):
    """A table of (doc_id, text) with further columns whose names clash."""
    return spark.createDataFrame([(i, t, "r", "l", 1, 2, "w", "s") for i, t in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Odd texts, each row twice, some under another id, and a null id."""
    rows = list(enumerate(ODD))
    rows += rows + [(100 + i, t) for i, t in rows] + [(None, "a null id has this text"), (None, None)]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def table(spark):
    root = os.environ.get("TESTDATA_DIR", "/root/testdata")
    return lambda name, sf="sf0.001": spark.read.parquet(f"{root}/{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path
