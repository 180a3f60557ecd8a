"""SimHash near-duplicates by a binary trie self-join (operator 2).

Fingerprints that differ in at most `budget` bits agree on at least one of budget + 1 blocks of bits. So each distinct fingerprint goes to one bucket for each
block, rotated so that the block leads, and the fingerprints of a bucket form a binary trie below it. The trie is joined with itself: pairs of nodes go down
together, the bits in which they differ add up, and a pair over the budget ends there. A bucket gives the links that span
it, not all pairs; components of all buckets' links are then found over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kind
from .components import components, spanning
from .runtime import cut, release, steps, written

BITS = 64
#: Node pairs that a task holds at once; more wait on a stack.
FRONTIER = 400_000
#: Fingerprints of a bucket beyond which it is dealt out by pairs of trie nodes SPLIT_BITS deeper, so that no task gets all of it.
HOT_BUCKET = 20_000
SPLIT_BITS = 8
#: Rows of buckets that a task gathers before it joins them.
GATHERED = 50_000
_SHINGLES = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that over half of the hashes have; without hashes 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _SHINGLES):
        counts += np.unpackbits(hashes[i : i + _SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text: each bit that is set in over half of its shingles' XXH64 (seed 42)."""
    found = text.encode().lower().split()
    if not found:
        return 0
    data, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(data, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    return majority(np.fromiter((digest(data[a:b], 42) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts)))


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `bits` bigint, its fingerprint as a signed number. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part, texts in steps(batches, "text"):
            bits = np.array([fingerprint(t, words) for t in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits)], ["id", "bits"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {_kind(df, id_col)}, bits bigint")


def trie_pairs(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, budget: int, top: int, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of keys that differ in at most `budget` bits, within each range [start, stop) of sorted distinct keys.

    top: the highest bit in which keys of a range can differ. With sides (0 or 1 for each key) only pairs of different sides are sought."""
    ones = {}

    def counted(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return ones[bit]

    whole = stops - starts > 1
    zero = np.zeros(int(whole.sum()), np.int64)
    stack = [(top, starts[whole], stops[whole], starts[whole], stops[whole], zero)]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, spent))), (bit, *(x[:half] for x in (a0, a1, b0, b1, spent)))]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if sides is not None:
                near &= sides[i] != sides[j]
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, spent = (x[~leaf] for x in (a0, a1, b0, b1, spent))
        if bit < 0 or not len(a0):
            continue
        c = counted(bit)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same, more = a0 == b0, spent + 1
        cross = ~same
        parts = [
            (a0, am, b0, bm, spent, None),  # zero with zero
            (am, a1, bm, b1, spent, None),  # one with one
            (a0, am, bm, b1, more, None),  # zero with one; in a node with itself once
            (am, a1, b0, bm, more, cross),
        ]
        kept = []
        for x0, x1, y0, y1, d, only in parts:
            alive = (x1 > x0) & (y1 > y0) & (d <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if only is not None:
                alive &= only
            kept.append([x[alive] for x in (x0, x1, y0, y1, d)])
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def _links(budget: int, width: int):
    """For mapInArrow over (bucket, key, side), with the rows of a bucket together and a key at most once in it: the links that span each bucket."""

    def joined(bucket: np.ndarray, key: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((key, bucket))
        bucket, key, side = bucket[order], key[order], side[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        stops = np.append(starts[1:], len(bucket))
        split = np.add.reduceat(side >= 0, starts) > 0
        root = np.arange(len(key))
        for chosen, sides in ((~split, None), (split, side)):
            if chosen.any():
                deep = BITS - 1 if sides is not None else BITS - 1 - width
                found = spanning(len(key), trie_pairs(key, starts[chosen], stops[chosen], budget, deep, sides))
                root = np.minimum(root, found)
        linked = np.flatnonzero(root != np.arange(len(key)))
        turn = bucket & 15
        back = lambda at: _rotated(key[at], (BITS - width * turn[at]) % BITS).view("<i8")
        return pa.RecordBatch.from_arrays([pa.array(back(linked)), pa.array(back(root[linked]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            waiting.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view("<u8"), batch.column(2).to_numpy()])
            size += batch.num_rows
            if size < GATHERED:
                continue
            rows = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            ends = np.flatnonzero(rows[0] != rows[0][-1])  # the last bucket may go on
            last = int(ends[-1]) + 1 if len(ends) else 0
            if last:
                yield joined(*(x[:last] for x in rows))
            waiting, size = [[x[last:] for x in rows]], 0
        if waiting and sum(len(x[0]) for x in waiting):
            yield joined(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return run


def _rotated(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, keys, (keys << by) | (keys >> ((np.uint64(BITS) - by) % np.uint64(BITS))))


def near_links(distinct: DataFrame, budget: int = 3, hot: int = HOT_BUCKET) -> DataFrame:
    """distinct `bits` to links (a, b) among them: a and b are connected by them exactly if steps of at most `budget` bits connect them.

    No pairs of a bucket are listed, only the links that span it, at most one a fingerprint and bucket. A bucket of over `hot` fingerprints is dealt out
    to pairs of trie nodes, each of which holds a small part of it."""
    blocks = budget + 1
    width = BITS // blocks
    if not 2 <= blocks <= 16:
        raise ValueError("the budget is from 1 to 15 bits")
    turned = [
        F.struct(
            F.lit(i).alias("block"),
            (F.shiftleft("bits", width * i).bitwiseOR(F.shiftrightunsigned("bits", BITS - width * i)) if i else F.col("bits")).alias("key"),
        )
        for i in range(blocks)
    ]
    rows = distinct.select(F.explode(F.array(*turned)).alias("x")).select(
        F.shiftleft(F.shiftrightunsigned("x.key", BITS - width), 4).bitwiseOR(F.col("x.block").cast("long")).alias("bucket"), F.col("x.key").alias("key")
    )
    # bucket: block in the lowest 4 bits, its value above; of a dealt bucket also the two node numbers.
    large = cut(rows.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"))
    plain = F.lit(-1).alias("side")
    if large.isEmpty():
        dealt = rows.select("bucket", "key", plain)
    else:
        node = F.shiftrightunsigned("key", BITS - width - SPLIT_BITS).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1)).cast("int")
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << SPLIT_BITS) - 1)), lambda v: F.bit_count(v.bitwiseXOR(node)) <= budget)
        parts = rows.join(large, "bucket", "left_semi").select("bucket", "key", node.alias("node"), F.explode(near).alias("other"))
        pair = F.shiftleft(F.least("node", "other").cast("long"), SPLIT_BITS).bitwiseOR(F.greatest("node", "other").cast("long"))
        shifted = F.shiftleft(F.shiftleft(F.shiftrightunsigned("bucket", 4), 2 * SPLIT_BITS + 1).bitwiseOR(pair).bitwiseOR(F.lit(1 << (2 * SPLIT_BITS))), 4)
        parts = parts.select(
            shifted.bitwiseOR(F.col("bucket").bitwiseAND(F.lit(15))).alias("bucket"), "key", F.when(F.col("node") == F.col("other"), -1).otherwise((F.col("node") > F.col("other")).cast("int")).alias("side")
        )
        dealt = rows.join(large, "bucket", "left_anti").select("bucket", "key", plain).union(parts)
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(budget, width), "a bigint, b bigint")


def near_duplicates(df: DataFrame, words: int = 3, budget: int = 3, hot: int = HOT_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, fingerprint string (16 lower-case hex digits), component_id of the id's type.

    Rows link if their fingerprints differ in at most `budget` bits; component_id is the smallest id that can be reached, the row's own included. Rows of equal
    fingerprints are one class before anything is joined. Texts without words (null, empty, white space) have fingerprint 0 and link like any other. A
    row whose id is null takes part but is never a component_id, unless nothing it reaches has an id: then that is null. Repeated rows stay. No rows give no rows."""
    kind = _kind(df, id_col)
    marked = written(fingerprints(df, words, id_col, text_col), "fingerprints")
    classes = cut(marked.groupBy("bits").agg(F.min("id").alias("least")))
    reach = components(near_links(classes.select("bits"), budget, hot)).select(F.col("node").alias("bits"), "component")
    label = classes.join(reach, "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    lowest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(lowest, "component").select("bits", "component_id")
    digits = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return marked.join(named, "bits").select(F.col("id").cast(kind).alias(id_col), digits.alias("fingerprint"), "component_id")
