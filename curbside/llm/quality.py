"""Quality filter by importance resampling.

Two generative models over hashed n-grams (words and punctuation runs, and pairs of
them) are fitted: one on target documents (labelled as good and not toxic), one on the
raw corpus, all of it. An n-gram's log ratio says how much likelier the target is to
use it. A document's weight is the product of its n-grams' ratios, each cut at one and
divided by what target text has on average (truncated importance weights): frequent good
n-grams can't outweigh bad ones, so long documents are judged as short ones are. Documents are then sampled without replacement
in proportion to their weights, by the Gumbel top-k rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm import textblocks as tb
from curbside.llm.common import documents, materialise, pack, row_key, unpack

#: Buckets of the models, as a power of two, for single n-grams and for pairs each.
BITS = 20
#: Log ratios above minus this (three times this for pairs) count as zero.
MARGIN = 0.7
#: Labelled documents used, those of the smallest hashes. Bounds what is broadcast.
LABELLED = 200_000
#: A lost target document counts as much as so many bad ones let through, in shares.
LOSS = 4
#: Divides the Gumbel noise's weight against the documents' log weights.
TEMPERATURE = 0.25

_SLICES = 64
_PUNCTUATION = bytes(
    c for c in range(0x21, 0x7F) if not (chr(c).isalnum() or c == 0x5F)
)
_CLASSES = tb.byte_classes(bytes([*range(0x00, 0x21), 0x7F]), _PUNCTUATION)


def _grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and bucket of every n-gram. Pairs have the upper half of the buckets."""
    tokens = tb.tokenise(texts, _CLASSES)
    starts, counts = tb.window_starts(tokens, 2)
    one = tokens.hashes >> np.uint64(64 - bits)
    two = (tb.rolling(tokens.hashes, 2)[starts] >> np.uint64(64 - bits)) + np.uint64(1 << bits)
    texts_ = np.arange(len(tokens))
    owner = np.concatenate([np.repeat(texts_, tokens.counts), np.repeat(texts_, counts)])
    return owner, np.concatenate([one, two]).astype(np.int64), len(tokens)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 << bits), dtype=np.int64)
        for block in tb.blocks(batches):
            owner, bucket, _ = _grams(block.column("text"), bits)
            target = block.column("target").to_numpy(zero_copy_only=False)
            counts[0] += np.bincount(bucket, minlength=2 << bits)
            good = bucket[target[owner]]
            if len(good):
                counts[1] += np.bincount(good, minlength=2 << bits)
        if counts.any():
            width = (2 << bits) // _SLICES
            yield pa.record_batch({
                "slice": pa.array(range(_SLICES), pa.int32()),
                "data": pa.array([
                    pack(counts[:, i * width : (i + 1) * width].reshape(-1))
                    for i in range(_SLICES)
                ], pa.binary()),
            })

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = unpack(data, np.int64)
            sums[i] = sums[i] + counts if i in sums else counts
    for i, counts in sums.items():
        yield pa.record_batch({
            "slice": pa.array([i], pa.int32()), "data": pa.array([pack(counts)], pa.binary())
        })


def _score(penalties, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches):
            owner, bucket, n = _grams(block.column("text"), bits)
            weight = np.bincount(owner, penalties.value[bucket], minlength=n)
            weight = np.minimum(weight, 0)
            yield pa.record_batch({
                "doc_id": block.column("doc_id"),
                "row": block.column("row"),
                "n_grams": pa.array(np.bincount(owner, minlength=n)),
                "log_weight": pa.array(weight),
                "label": block.column("label"),
            })

    return run


def _labels(labels: DataFrame, limit: int) -> DataFrame:
    """At most `limit` labelled ids with label 1 (target) or 0; an id that any row calls
    bad or toxic is 0. Null judgements don't count."""
    good = F.col("quality").cast("int") == 1
    bad = (F.col("quality").cast("int") == 0) | (F.col("toxic").cast("int") == 1)
    judged = (
        labels.select(F.col("doc_id").cast("bigint").alias("labelled"),
                      F.when(bad, 0).when(good, 1).alias("label"))
        .dropna().groupBy("labelled").agg(F.min("label").alias("label"))
    )
    return judged.orderBy(F.xxhash64("labelled"), "labelled").limit(limit)


def fit(rows: DataFrame, bits: int, margin: float) -> np.ndarray | None:
    """Cut log ratios per bucket, of `rows` (text, label); None without any target."""
    marked = rows.select("text", F.coalesce(F.col("label") == 1, F.lit(False)).alias("target"))
    slices = (
        marked.mapInArrow(_count(bits), "slice int, data binary")
        .repartition(_SLICES, "slice")
        .mapInArrow(_add, "slice int, data binary")
    )
    counts = np.zeros((2, 2 << bits), dtype=np.float64)
    width = (2 << bits) // _SLICES
    for i, data in slices.collect():  # one array for each of the slices
        counts[:, i * width : (i + 1) * width] = unpack(bytes(data), np.int64).reshape(2, width)
    if not counts[1].any():
        return None
    raw, target = counts.reshape(2, 2, -1)  # order of the n-gram, bucket
    expected = raw * (target.sum(1) / np.maximum(raw.sum(1), 1))[:, None]
    # What the target may hold at most, two standard errors up, against what it would
    # hold if it were as the raw text: rare n-grams prove nothing.
    most = target + 2 * np.sqrt(target + 1) + 1
    ratio = np.log(most) - np.log(np.maximum(expected, 1e-9))
    # Pairs are far more kinds than words, so by chance alone more of them look bad.
    cut = np.minimum(ratio + margin * np.array([[1.0], [3.0]]), 0)
    # A target document's n-grams add up to nothing on average, however many they are.
    usual = (cut * target).sum(1) / np.maximum(target.sum(1), 1)
    return (cut - usual[:, None]).reshape(-1).astype(np.float32)


def cutoff(scored: DataFrame, limit: int) -> float:
    """The log weight that parts the labelled documents best: the share of
    others below, less LOSS times that of targets below, is largest. Without both
    kinds, nothing is cut."""
    labelled = scored.filter("label is not null").orderBy(F.xxhash64("row"), "row").limit(limit)
    sample = labelled.select("log_weight", "label").toPandas()  # at most `limit` rows
    weight = sample["log_weight"].to_numpy()
    good = sample["label"].to_numpy() == 1
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    lost = np.append(0, np.cumsum(good)) / good.sum()
    caught = np.append(0, np.cumsum(~good)) / (~good).sum()
    allowed = np.append(True, weight[1:] != weight[:-1])
    allowed = np.append(allowed, False)
    gain = np.where(allowed, caught - LOSS * lost, -np.inf)
    at = int(np.argmax(gain))
    if at == 0:
        return -np.inf
    return float((weight[at - 1] + weight[at]) / 2)


def _rank_threshold(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The k-th largest of the integer keys (key, row), found by halving the range of
    keys into 4096 bins a round; rows of that very key are told apart by `row`."""
    for column in ("key", "row"):
        low, high = keys.agg(F.min(column), F.max(column)).first()
        while low < high:
            step = (high - low) // 4096 + 1
            bins = (
                keys.groupBy(F.expr(f"({column} - {low}L) div {step}L").alias("bin"))
                .count().orderBy(F.desc("bin")).collect()  # 4096 at most
            )
            for b, n in bins:
                if n >= k:
                    break
                k -= n
            low, high = low + b * step, min(low + (b + 1) * step - 1, high)
            keys = keys.filter(F.col(column).between(low, high))
        if column == "key":
            key = low
            keys = keys.filter(F.col("key") == key)
    return key, low


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    seed: int = 17,
    bits: int = BITS,
    margin: float = MARGIN,
    labelled: int = LABELLED,
    temperature: float = TEMPERATURE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_grams, log_weight (0 at most), gumbel_key, kept, row (a hash of id
    and text).

    `kept` marks the k rows of the largest keys log_weight / temperature + Gumbel noise
    (noise by hash of `seed`, id and text). Without `k`, k is the number of documents whose
    log weight is above the cutoff that parts the labelled documents best. All documents
    are counted and scored; labels of `labelled` documents at most are used (and of twice as
    many rows, those of the smallest hashes, if ids repeat). Null and
    empty texts have no n-grams and weight 1 (log 0). Rows repeating id and text have
    equal keys and are kept or dropped together (a tie at the k-th place is kept).
    Without labelled targets every weight is 1 and, without `k`, everything is kept.
    Null ids are scored like others and have no label. Other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    base = documents(docs, key, text)
    judged = F.broadcast(_labels(labels, labelled))  # `labelled` rows at most
    rows = base.join(judged, F.col("doc_id") == F.col("labelled"), "left").select(
        "doc_id", row_key().alias("row"), "text", "label"
    )
    penalties = fit(rows, bits, margin)
    if penalties is None:
        penalties = np.zeros(2 << bits, dtype=np.float32)
    scored = materialise(
        rows.mapInArrow(
            _score(spark.sparkContext.broadcast(penalties), bits),
            "doc_id bigint, row bigint, n_grams bigint, log_weight double, label int",
        ),
        "scored",
    )
    if k is None:
        k = scored.filter(F.col("log_weight") >= F.lit(cutoff(scored, 2 * labelled))).count()
    uniform = (F.xxhash64(F.lit(seed), "row").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    noisy = F.col("log_weight") / temperature - F.log(-F.log(uniform))
    keyed = scored.withColumn("gumbel_key", noisy).withColumn(
        "key", (F.greatest(F.col("gumbel_key"), F.lit(-1e9)) * (1 << 32)).cast("bigint")
    )
    total = scored.count()
    if k >= total:
        kept = F.lit(True)
    elif k <= 0:
        kept = F.lit(False)
    else:
        at, row = _rank_threshold(keyed.select("key", "row"), k)
        kept = (F.col("key") > at) | ((F.col("key") == at) & (F.col("row") >= row))
    return keyed.select(
        "doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"), "row"
    )
