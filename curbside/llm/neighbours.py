"""Nearest neighbours over randomly rotated one-bit codes.

Vectors belong to the cell of their nearest centre. There they are centred, rotated at
random and kept as the signs of their coordinates, their norm, and the cosine between
themselves and their signs. For a query, the inner product with the signs, divided by that
cosine, estimates the inner product with the vector, and the cosine also bounds the
estimate's error. Vectors whose smallest possible distance is within the k-th smallest
largest one are reranked by their exact distance.

Cells are cut into blocks. A block's codes and vectors go to one task, once, and the queries
that concern the block follow behind them and are answered batch by batch. Each query first
asks one block of its own cell; the distance to the k-th row found there then rules out, by
the triangle inequality, all cells that lie wholly farther away. So cells cost no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import materialise

#: Vectors from which the centres are fitted, those of the smallest hashes, and the centres.
SAMPLE = 20_000
CELLS = 256
#: Standard deviations that an estimate's error bound spans.
SPREAD = 3.0
#: Rows of a block, and queries answered at a time.
BLOCK, QUERIES = 16_384, 512


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed signs, norms and correction cosines."""
    moved = (vectors - centre) @ turn
    norms = np.linalg.norm(moved, axis=1)
    safe = np.where(norms > 0, norms, 1)
    cosines = np.abs(moved).sum(axis=1) / (np.sqrt(vectors.shape[1]) * safe)
    cosines = np.where(norms > 0, cosines, 1)
    return np.packbits(moved > 0, axis=1), norms, cosines


def bounds(signs, norms, cosines, queries, centre, turn, spread: float):
    """Smallest and largest squared distance (vector, query), but for rare errors."""
    dim = queries.shape[1]
    moved = (queries - centre) @ turn
    size = np.linalg.norm(moved, axis=1)
    code = np.unpackbits(signs, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = (code @ moved.T.astype(np.float32)) / np.sqrt(dim) / cosines[:, None]
    off = np.sqrt(np.maximum(1 - cosines**2, 0)) / cosines * spread / np.sqrt(max(dim - 1, 1))
    error = off[:, None] * size[None, :] + 1e-5 * size[None, :]
    base = norms[:, None] ** 2 + size[None, :] ** 2
    twice = 2 * norms[:, None]
    return base - twice * (inner + error), base - twice * (inner - error)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres of groups of near vectors. Without a sample there is one, at the origin."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[: max(1, min(cells, len(sample) // 64))].copy()
    for _ in range(rounds if len(centres) > 1 else 0):
        own = _nearest_centre(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres if len(centres) > 1 else sample.mean(axis=0, keepdims=True)


def _nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def _index(dim: int, centres: np.ndarray, turn: np.ndarray):
    """Cell, signs, norm (the distance from the cell's centre) and cosine of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dim)
            cells = _nearest_centre(vectors, centres)
            signs, norms, cosines = encode(vectors, centres[cells], turn)
            packed = [row.tobytes() for row in signs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.astype(np.int32)), pa.array(packed, pa.binary()),
                 pa.array(norms), pa.array(cosines)],
                names=[*batch.schema.names, "cell", "signs", "norm", "cosine"],
            )

    return run


def _targets(dim: int, centres: np.ndarray, first: np.ndarray, radii: np.ndarray):
    """For each query the blocks that can hold one of its neighbours, given the distance
    `bound` to as many rows as are wanted. Cell `c` has blocks `first[c]:first[c + 1]`."""
    sizes = np.diff(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                vectors = _matrix(part.column("vector"), dim)
                bound = part.column("bound").to_numpy()
                away = np.sqrt(((vectors[:, None] - centres[None]) ** 2).sum(axis=2))
                near = away - radii[None] <= bound[:, None] + 1e-9 * (away + radii[None])
                query, cell = np.nonzero(near & (sizes > 0))
                counts = sizes[cell]
                begin = np.cumsum(counts) - counts
                block = np.repeat(first[cell] - begin, counts) + np.arange(counts.sum())
                yield part.take(pa.array(np.repeat(query, counts))).append_column(
                    "block", pa.array(block.astype(np.int32))
                )

    return run


def _search(k: int, dim: int, centres: np.ndarray, cell_of: np.ndarray, turn, spread: float):
    """Rows come sorted by block, a block's vectors before its queries."""

    def ask(block: int, held: list, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, vectors, signs, norms, cosines = held
        query_ids = batch.column("vec_id").to_numpy()
        queries = _matrix(batch.column("vector"), dim)
        bound = batch.column("bound").to_numpy()
        low, high = bounds(
            signs, norms, cosines, queries, centres[cell_of[block]], turn, spread
        )
        high[ids[:, None] == query_ids[None]] = np.inf  # its own rows limit nothing
        if len(ids) > k:
            limit = np.partition(high, k - 1, axis=0)[k - 1]
        else:
            limit = np.full(len(query_ids), np.inf)
        limit = np.minimum(limit, bound**2 * (1 + 1e-9))
        close = low <= limit
        out = [], [], []
        for q in range(len(query_ids)):
            some = np.flatnonzero(close[:, q])
            some = some[ids[some] != query_ids[q]]
            score = np.sqrt(((vectors[some] - queries[q]) ** 2).sum(axis=1))
            best = np.lexsort((ids[some], score))[:k]
            out[0].append(np.full(len(best), query_ids[q]))
            out[1].append(ids[some[best]])
            out[2].append(score[best])
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.concatenate(out[0]), pa.int64()),
            "vec_id": pa.array(np.concatenate(out[1]), pa.int64()),
            "score": pa.array(np.concatenate(out[2]), pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (asks[1:] != asks[:-1])) + 1
            limits = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(limits[:-1], limits[1:], strict=True):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, rows, held = blocks[a], [], None
                if not asks[a]:
                    signs = b"".join(part.column("signs").to_pylist())
                    rows.append((
                        part.column("vec_id").to_numpy(),
                        _matrix(part.column("vector"), dim),
                        np.frombuffer(signs, dtype=np.uint8).reshape(part.num_rows, -1),
                        part.column("norm").to_numpy(),
                        part.column("cosine").to_numpy(),
                    ))
                    continue
                if held is None and rows:
                    held, rows = [np.concatenate(x) for x in zip(*rows, strict=True)], []
                if held is not None:
                    for at in range(0, part.num_rows, QUERIES):
                        yield from ask(block, held, part.slice(at, QUERIES))

    return run


def taking_part(vector: Column, dim: int) -> Column:
    """Of `dim` components, all finite and some not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    seed: int = 17,
    sample: int = SAMPLE,
    spread: float = SPREAD,
    block: int = BLOCK,
    cells: int = CELLS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others of each row where `is_query` (a
    condition on `vectors`), by Euclidean distance in double precision, ties to the
    smaller id.

    Null, zero, or non-finite vectors take no part, nor do those of another length than
    most have (the longer of equally frequent ones), nor null ids. Of rows that repeat an
    id, each is a candidate of the other ids' queries, and the first by value asks. With
    fewer candidates, all are returned; an empty table gives no rows. The centres of at most
    `cells` cells are fitted on `sample` rows; every row is indexed. Other columns are not
    looked at.
    """
    kept = vectors.schema[vector].dataType
    if kept not in (T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)):
        kept = T.ArrayType(T.DoubleType())
    rows = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"),
        F.col(vector).cast(kept).alias("vector"), is_query.alias("asks"),
    ).filter("vec_id is not null and vector is not null")
    sizes = rows.groupBy(F.size("vector").alias("dim")).count()
    most = sizes.filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 1
    real = rows.filter(taking_part(F.col("vector"), dim))
    some = (
        real.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    )
    fitted = np.stack(some["vector"]).astype(float) if len(some) else np.empty((0, dim))
    centres, turn = fit_cells(fitted, cells), rotation(dim, seed)
    codes = "cell int, signs binary, norm double, cosine double"
    index = materialise(
        real.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _index(dim, centres, turn),
            f"vec_id bigint, vector {kept.simpleString()}, asks boolean, row bigint, {codes}",
        ),
        "codes",
    )
    # One row for each cell.
    found = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("r")).collect()
    counts, radii = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for cell in found:
        counts[cell["cell"]], radii[cell["cell"]] = -(-cell["n"] // block), cell["r"]
    first = np.append(0, np.cumsum(counts)).astype(np.int64)
    cell_of = np.repeat(np.arange(len(centres)), counts)

    table = F.array(*(F.lit(int(x)) for x in first))  # a number for each cell
    blocks = F.get(table, F.col("cell") + 1) - F.get(table, F.col("cell"))
    own = F.get(table, F.col("cell")) + F.pmod(F.xxhash64("row"), blocks)
    placed = index.withColumn("block", own.cast("int"))
    queries = placed.filter("asks").groupBy("vec_id").agg(
        F.min_by(F.struct("vector", "block"), F.struct("vector", "row")).alias("q")
    ).select("vec_id", "q.*")
    layout = ["block", "asks", "vec_id", "vector", "signs", "norm", "cosine", "bound"]
    stored = placed.select(
        "block", F.lit(False).alias("asks"), "vec_id", "vector", "signs", "norm", "cosine",
        F.lit(None).cast("double").alias("bound"),
    )
    search = _search(k, dim, centres, cell_of, turn, spread)
    tasks = max(1, min(len(cell_of), 4 * int(index.sparkSession.sparkContext.defaultParallelism)))

    def met(asked: DataFrame) -> DataFrame:
        both = stored.unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        return (
            both.select(*layout).repartition(max(tasks, len(cell_of) // 8), "block")
            .sortWithinPartitions("block", "asks")
            .mapInArrow(search, "query_id bigint, vec_id bigint, score double")
        )

    without = F.lit(float("inf"))
    near = met(queries.withColumn("bound", without)).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("score").alias("score")
    )
    bound = F.when(F.col("n") >= k, F.col("score")).otherwise(without)
    bounded = materialise(
        queries.join(near, F.col("vec_id") == F.col("query_id"), "left")
        .select("vec_id", "vector", F.coalesce(bound, without).alias("bound")),
        "queries",
    )
    asked = bounded.mapInArrow(
        _targets(dim, centres, first, radii),
        f"vec_id bigint, vector {kept.simpleString()}, bound double, block int",
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        met(asked).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
