"""Exact top-k search by pivot-table elimination (operator 5).

The distances of every vector to a set of pivots are computed once and stored with it. For a query and a candidate the largest difference of their distances to a
pivot is a lower bound of their distance, and so an upper bound of their inner product. Candidates are evaluated in the order of these bounds; a query stops
once the next bound is below its k-th score, so no candidate that could enter is missed. A query begins with the k-th best score of a sample of the
candidates, so that what that sample beats is eliminated in every block.

Queries and candidates meet in blocks: each block of queries with each block of candidates, and only the k best of a pair of blocks go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _kind
from .runtime import written
from .vectors import matrix, usable

PIVOTS = 32
#: Rows (at most; by a hash of the id) that pivots are chosen among and queries take their first threshold from. The choice changes the work, never the result.
PIVOT_ROWS = 2_000
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 1_024
#: Partitions that the pairs of blocks are dealt to, at most.
MOST_PARTITIONS = 20_000
SCALE = 1024
#: Candidates of a query that are evaluated at first, in bound order; each further round is four times as large.
ROUND = 64
_EXACT = 2.0**53
_LEAST = -(1 << 63)


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, in double precision."""
    return np.floor(SCALE * vectors.astype(np.float64))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each farthest from those before it."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row of distances for each vector."""
    out = np.empty((len(vectors), len(pivots)))
    for i in range(len(pivots)):
        out[:, i] = np.sqrt(((vectors - pivots[i]) ** 2).sum(1))
    return out


def _products(candidates: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as exact integers; beyond 2**53 with Python's numbers, held to 64 bits."""
    if exact:
        return (candidates @ query).astype(np.int64)
    whole = [int(v) for v in query]
    least, most = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), least), most) for row in candidates], np.int64)


def best_of_block(query: np.ndarray, row: int, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, exact: bool, least: int = _LEAST) -> tuple[np.ndarray, int]:
    """Places of the k best candidates of one query (highest score, then smallest id) with their scores, and how many were evaluated.

    bound: an upper bound of each candidate's score. row: the query's own row, which is no candidate. least: a score that k candidates of the table are known to reach."""
    some = np.flatnonzero((rows != row) & (bound >= least))
    order = some[np.argsort(-bound[some], kind="stable")]
    kept, scores, at, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, ROUND
    while at < len(order) and (len(kept) < k or bound[order[at]] >= scores[-1]):
        new = order[at : at + size]
        at, size = at + len(new), 4 * size
        score = _products(vectors[new], query, exact)
        good = score >= least
        kept, scores = np.concatenate((kept, new[good])), np.concatenate((scores, score[good]))
        best = np.lexsort((ids[kept], -scores))[:k]
        kept, scores = kept[best], scores[best]
    return np.stack((kept, scores)), at


def search(df: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank int (from 1), the id, score bigint.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own. Vectors are floor(1024 * component). Ties
    go to the smaller id. Rows whose vector is null or empty or has a null or non-finite component, or whose id is null, take no part. Of vectors of different
    lengths the shorter counts as filled with zeros. Rows of a repeated id are candidates each; a repeated query id is one query, that of the
    row read first, and its other rows are candidates. Fewer candidates than k give fewer rows. Scores beyond 64 bits are held to the nearest bigint."""
    spark, kind = df.sparkSession, _kind(df, id_col)
    number = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("vector"))
    total = rows.count()
    turn = F.pmod(F.xxhash64("id"), F.lit(1_000_000_000))
    sample = rows.where(turn <= int(1_000_000_000 * min(1.0, 1.2 * PIVOT_ROWS / max(1, total)))).orderBy(turn, "id", "vector").limit(PIVOT_ROWS).collect()
    width = max((len(r.vector) for r in sample), default=0)
    some = quantised(np.array([r.vector + [0.0] * (width - len(r.vector)) for r in sample]).reshape(len(sample), width))
    fixed = spark.sparkContext.broadcast((choose_pivots(some, pivots), some, np.array([r.id for r in sample], np.int64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's distances to the pivots, and for queries a first threshold."""
        chosen, known, known_ids = fixed.value
        for batch in batches:
            vectors = batch.column(2)
            z = quantised(matrix(vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()))
            ids = batch.column(0).to_numpy()
            near = pivot_distances(*_even(z, chosen)).astype(np.float32)
            least = np.full(len(ids), _LEAST, np.int64)
            for i in np.flatnonzero(ids % every == 0):
                query, others = _even(z[i : i + 1], known[known_ids != ids[i]])
                if len(others) >= k and _is_exact(query, others):
                    least[i] = int(np.partition(others @ query[0], len(others) - k)[len(others) - k])
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1))), pa.array(least)], ["id", "row", "vector", "near", "least"])

    marked = rows.select("id", F.monotonically_increasing_id().alias("row"), "vector").mapInArrow(mark, f"id bigint, row bigint, vector array<{number}>, near array<float>, least bigint")
    held = written(marked, "vectors")
    first = held.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by(F.struct("row", "vector", "near", "least"), "row").alias("x")).select("id", "x.*")
    count = max(1, -(-first.count() // QUERY_BLOCK))
    parts = max(1, -(-total // CANDIDATE_BLOCK))
    # Each block of queries meets each block of candidates: a row goes to all blocks of the other side, and the pairs are dealt out by both numbers.
    dealt = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("q"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("c"), F.lit(False).alias("asks"))
    asked = first.select(*held.columns, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("c"), F.lit(True).alias("asks"))
    pairs = dealt.union(asked).repartition(min(MOST_PARTITIONS, count * parts), "q", "c").groupBy("q", "c").agg(F.collect_list(F.struct(*held.columns, "asks")).alias("all"))
    fields = ("id", "row", "least", "asks")
    pairs = pairs.select(*(F.col(f"all.{f}").alias(f) for f in fields), F.transform("all", lambda x: F.size(x["vector"])).alias("sizes"), F.flatten("all.vector").alias("values"), F.flatten("all.near").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _meet(*one, k)], ["query_id", "id", "score"])

    best = pairs.mapInArrow(run, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))  # with its limit, Spark keeps k rows a query before it shuffles
    ranked = best.select("*", rank.cast("int").alias("rank")).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(id_col), "score")


def _even(*tables: np.ndarray) -> list[np.ndarray]:
    """Tables of numbers, filled with zeros to the widest of those with rows."""
    width = max((x.shape[1] for x in tables if len(x)), default=0)
    return [np.pad(x, ((0, 0), (0, width - x.shape[1]))) if len(x) else np.zeros((0, width)) for x in tables]


def _is_exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of a and b are exact in double precision."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    return bool(a.shape[1] * most * most < _EXACT)


def _meet(ids, rows, least, asks, sizes, values, near, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, id, score) of the k best of each query of a block among the candidates of a block."""
    z, near = quantised(matrix(values, sizes)), near.reshape(len(ids), -1)
    asks = asks.astype(bool)
    ask, there = np.flatnonzero(asks), np.flatnonzero(~asks)
    queries, vectors = z[ask], z[there]
    out = [(np.zeros(0, np.int64),) * 3]
    if not len(ask) or not len(there):
        return out[0]
    exact = _is_exact(queries, vectors)
    if exact:
        low = np.zeros((len(ask), len(there)), np.float32)
        for p in range(near.shape[1]):
            np.maximum(low, np.abs(near[ask, p][:, None] - near[there, p]), out=low)
        low = np.maximum(low - 1e-6 * near.max(initial=0), 0).astype(np.float64)  # distances are of single precision
        # q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2; the bound of the distance is rounded down, that of the score up.
        bounds = ((queries**2).sum(1)[:, None] + (vectors**2).sum(1) - low * low) / 2 + 1
    else:
        bounds = np.full((len(ask), len(there)), np.finfo(np.float64).max)
    for i, at in enumerate(ask):
        (places, scores), _ = best_of_block(queries[i], rows[at], vectors, ids[there], rows[there], bounds[i], k, exact, int(least[at]))
        out.append((np.full(len(places), ids[at]), ids[there][places], scores))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
