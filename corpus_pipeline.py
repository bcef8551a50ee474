"""The corpus pipeline: documents through five stages, each a written table.

`run` gives what the last stage returns; `STAGES` can be run one by one, each on what
its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import materialise
from curbside.llm.decontaminate import decontaminate
from curbside.llm.neardup import near_duplicates
from curbside.llm.pieces import encode_pieces
from curbside.llm.pii import redact
from curbside.llm.quality import importance_resample


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are installed, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text have a verdict that keeps them. Of the rows of
    one id each has its own verdict. Rows with a null id stay."""
    lost = verdicts.filter("not kept and doc_id is not null").select(F.col("row").alias("lost"))
    own = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    own = docs.select(F.struct(*docs.columns).alias("doc"), own.alias("own"))
    return own.join(lost.distinct(), F.col("own") == F.col("lost"), "left_anti").select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts stay, and so
    do null ids; equal rows go or stay together; other columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(docs, importance_resample(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays. Shingles of five words, similarity 0.8. Null, empty
    and blank texts are no one's copies. Rows that repeat id and text are one; rows of one id
    with other texts are one document and stay or go together. Rows of a null id all stay."""
    kept = _kept(docs, near_duplicates(docs, width=5))
    named = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of benchmark items go. Null and empty texts, and all rows
    if the benchmark is empty, stay; equal rows go or stay together."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. A null text stays
    null, with a null n_chars. Every row stays."""
    cut = redact(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the document's pieces, with merge dropout. Null and empty texts have none;
    every row has one, null ids and repeated ones too."""
    pieces = encode_pieces(docs, vocabulary("piece_bpe_32k.model"))
    return pieces.select("doc_id", "pieces", F.size("pieces").cast("bigint").alias("n_pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode_documents),
]

#: Hash models, MinHash groups and merge dropout have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
