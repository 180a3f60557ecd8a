"""Connected components of a link table by alternating large and small stars, between which every task contracts the links that it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import counted, cut

#: More rounds than any graph of 2**60 nodes needs in practice; reaching it is an error, not a result.
MOST_ROUNDS = 60
#: Links that a task contracts at once. A table of fewer is solved by one.
GATHERED = 500_000


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n nodes the least node that each reaches by the pairs; needs memory for the nodes and one batch of pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (flat := root[root] != root).any():
                root[flat] = root[root[flat]]
    return root


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes: of the links that a task holds, one from each node to the least that it reaches by them."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = (table.column(i).to_numpy() for i in (0, 1))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = spanning(len(nodes), iter([(place[: len(a)], place[len(a) :])]))
        some = np.flatnonzero(root != np.arange(len(nodes)))
        kind = table.schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(nodes[some], kind), pa.array(nodes[root[some]], kind)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= GATHERED:
                yield joined(held)
                held = []
        if any(x.num_rows for x in held):
            yield joined(held)

    return edges.mapInArrow(run, edges.schema)


def _falling(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star. Minima are aggregated before the shuffle, and a hub's neighbours are never gathered in one row."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = _falling(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    own = low.select("a", F.col("m").alias("b"))
    rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _falling(own.union(rest)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of an orderable type to (node, component): the smallest node that can be reached, for every node that has an edge to another.

    Edges may be repeated and in either order; those with a null or to itself link nothing. No edges give no rows. Only two numbers a round reach the driver."""
    now, n = counted(_contracted(_falling(edges.select("a", "b").dropna())))
    seen = None
    for _ in range(MOST_ROUNDS):
        if n < GATHERED:
            now = cut(_contracted(now.coalesce(1)))
            break
        now, n = counted(_contracted(_round(now)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return found[0], int(found[1] or 0)
