"""Near copies of texts by the similarity of their word shingles (the corpus pipeline's near-duplicate stage, with operator 2's fingerprints and trie join).

The trie self-join over SimHash fingerprints proposes pairs within a few bits. At a similarity of four fifths most pairs are farther apart than any budget that
a trie can prune, so an exact filter proposes the rest: two sets of which at least MOST in OF of all their shingles are common share one of the rarest few of
either, in any fixed order: n - ceil(n * MOST / OF) + 1 of n. So texts meet in the buckets of those. Whatever was proposed is compared in full: no pair is
missed and none is guessed. The order puts shingles first that a sample of the texts doesn't hold often; it decides how many pairs meet, not which are found.

A bucket isn't compared pair by pair: first a text with one partner, then with two members of each of its buckets, then in rounds with the likeliest of further
members, and at last only members that are still in different components, and of these only pairs whose sketches allow that they are similar: a shingle that only one of two
sets holds turns one of SKETCH bits, so they differ in at least as many shingles as their sketches do in bits. Before the sets of a pair are made and moved, sketches with
a bit for each of their shingles, which say as much of long texts as of short ones, have to allow it too. The buckets of the
common shingles, which alone can be large, are never gathered: their two members are aggregated before the shuffle and broadcast, MOST_COMMON at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import counted, held, steps, written
from .simhash import majority, near_links

WORDS = 5
#: The least similarity (shingles in common by all shingles of both) is MOST / OF.
MOST, OF = 4, 5
#: Bits within which the trie join proposes pairs.
BUDGET = 3
#: One text in SAMPLE_OF tells which shingles are common: those that LEAST_COMMON of them hold, at most MOST_COMMON.
SAMPLE_OF, LEAST_COMMON, MOST_COMMON = 16, 3, 200_000
#: Bits of a set's sketch, and the least of its wide one.
SKETCH = 512
#: Rounds in which texts of a bucket are compared with other members than the first two; they end earlier when one finds less than one similar pair in LEAST_FOUND of the first one's.
ROUNDS, LEAST_FOUND = 4, 20
#: Up to so many ids are broadcast, so that the texts they pick are not shuffled.
BROADCAST_IDS = 1_000_000
#: Words whose hashes one worker keeps; the store is emptied when it is full. Longer words are not kept.
KEPT_WORDS, KEPT_BYTES = 300_000, 64
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Words(dict):
    """The XXH64 (seed 42) of words, of frequent ones kept."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


def _words() -> _Words:
    return held("shingles", _Words)


def shingles(text: str, words: int = WORDS, known: _Words | None = None) -> np.ndarray:
    """64-bit hashes of a text's distinct shingles, ascending, as signed numbers. Fewer words are one shingle, no words none."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, "<i8")
    known = _Words() if known is None else known
    each = np.fromiter(map(known.__getitem__, found), "<u8", len(found))
    size = min(words, len(found))
    many = len(each) - size + 1
    mixed = np.full(many, size, "<u8")
    for i in range(size):
        mixed = mixed * np.uint64(_STEP) + each[i : i + many]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view("<i8"))


def sketch(own: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """So many bits (a power of two), as signed numbers: each tells whether an odd number of the shingles fall on it."""
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(own: np.ndarray) -> np.ndarray:
    """A sketch of at least a bit for each shingle. Half of a wider one, turned by its other half, is the sketch of half its bits."""
    return sketch(own, max(SKETCH, 1 << (len(own) - 1).bit_length() if len(own) else 0))


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, "<i8")))


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(id, text) to (id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words()
        for part, texts in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(t, words, known) for t in texts])], ["id", "shingles"])

    return df.mapInArrow(run, "id bigint, shingles array<bigint>")


def _marks(df: DataFrame, words: int) -> DataFrame:
    """(id, text) to (id, high, low, bits, n, sketch, wide): 128 bits that are the same for equal sets of shingles, the set's SimHash, its size and its sketches (wide: null where it is the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words()
        for part, texts in steps(batches, "text"):
            sets = [shingles(t, words, known) for t in texts]
            found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            bits = np.array([majority(x.view("<u8")) for x in sets], "<u8").view("<i8")
            wide = pa.array([wide_sketch(x) if len(x) > SKETCH else None for x in sets], pa.list_(pa.int64()))
            columns = [part.column(0), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(bits), pa.array([len(x) for x in sets], pa.int32()), _lists([sketch(x) for x in sets]), wide]
            yield pa.RecordBatch.from_arrays(columns, ["id", "high", "low", "bits", "n", "sketch", "wide"])

    return df.mapInArrow(run, "id bigint, high bigint, low bigint, bits bigint, n int, sketch array<bigint>, wide array<bigint>")


def _common(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of a sample of sets, ascending, and how many of the sets hold each."""
    counts, _ = counted(sample.select(F.explode("shingles").alias("token")).groupBy("token").count().where(F.col("count") >= LEAST_COMMON))
    least, held = LEAST_COMMON, 0
    for row in counts.groupBy(F.least("count", F.lit(10_000)).alias("often")).agg(F.count("*").alias("n")).orderBy(F.desc("often")).collect():
        held += row.n
        if held > MOST_COMMON:
            least = row.often + 1
            break
    found = counts.where(F.col("count") >= least).orderBy("token").toArrow()
    return found.column("token").to_numpy(), found.column("count").to_numpy()


def _rarest(df: DataFrame, words: int, tokens, counts) -> DataFrame:
    """(id, text) to (id, n, rare, rarest): the size of the set and as many of its shingles, rarest first, as a similar set must share one of; the
    first `rare` of them are not among the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, known, often = _words(), tokens.value, counts.value
        for part, texts in steps(batches, "text"):
            sizes, rare, found = [], [], []
            for t in texts:
                own = shingles(t, words, store)
                n, common = len(own), 0
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    seen = np.where(known[at] == own, often[at], 0)
                    own, common = own[np.argsort(seen, kind="stable")], int((seen > 0).sum())
                own = own[: n - -(-n * MOST // OF) + 1] if n else own
                sizes.append(n)
                rare.append(min(len(own), n - common))
                found.append(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), _lists(found)], ["id", "n", "rare", "rarest"])

    return df.mapInArrow(run, "id bigint, n int, rare int, rarest array<bigint>")


def _can_be(x: Column, y: Column) -> Column:
    """Whether two sets can be similar, by their sizes (the upper half of x and y) and the places of a first common shingle in them (the lower half)."""
    n, m = F.shiftright(x, 32), F.shiftright(y, 32)
    most = F.least(n - x.bitwiseAND(F.lit(0xFFFFFFFF)), m - y.bitwiseAND(F.lit(0xFFFFFFFF)))
    return most * (MOST + OF) >= (n + m) * MOST


def _turned(x: str, y: str) -> Column:
    """In how many bits two sketches differ: no more than the shingles that only one of the sets holds."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, SKETCH // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))


def _allowed(x: str, y: str, x_place: str, y_place: str) -> Column:
    """Whether two sets can be similar, by their sketches and the sizes in their places."""
    return _turned(x, y).cast("long") * (MOST + OF) <= (F.shiftright(x_place, 32) + F.shiftright(y_place, 32)) * (OF - MOST)


def _wide_turned(x: str, y: str) -> Column:
    """In how many bits two wide sketches differ, the longer of them halved. Sets of which one is more than twice as long are not similar, whatever this says."""
    least = F.least(F.size(x), F.size(y))
    turn = lambda p, q: p.bitwiseXOR(F.coalesce(q, F.lit(0).cast("bigint")))
    halved = [F.zip_with(F.slice(of, F.lit(1), least), F.slice(of, least + 1, least), turn) for of in (x, y)]
    return F.aggregate(F.zip_with(*halved, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda so_far, n: so_far + n)


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of the pairs (a, b)."""
    return few(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def _possible(pairs: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """Of the pairs (a, b) of classes those whose wide sketches allow that they are similar, and how many these are."""
    own = classes.join(_ends(pairs).withColumnRenamed("id", "class"), "class", "left_semi").select("class", F.col("n").cast("long").alias("n"), F.coalesce("wide", "sketch").alias("wide"))
    first, second = (own.select(F.col("class").alias(at), F.col("n").alias(f"{at}_n"), F.col("wide").alias(f"{at}_wide")) for at in "ab")
    allowed = _wide_turned("a_wide", "b_wide").cast("long") * (MOST + OF) <= (F.col("a_n") + F.col("b_n")) * (OF - MOST)
    return counted(pairs.join(first, "a").join(second, "b").where(allowed).select("a", "b"))


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> tuple[DataFrame, int]:
    """Of the pairs (a, b) of classes those whose sets are similar, counted in full, and how many these are. Only sets of pairs that their sketches allow are made and moved."""
    pairs, n = _possible(pairs, classes)
    if not n:
        return pairs, 0
    ids = _ends(pairs)
    sets = _sets(texts.join(ids, "id", "left_semi"), words).repartition("id")
    first, second = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return counted(pairs.join(first, "a").join(second, "b").where(both * (MOST + OF) >= (F.size("x").cast("long") + F.size("y")) * MOST).select("a", "b"))


def _reached(links: DataFrame) -> DataFrame:
    """The components (class, component) of the links (a, b)."""
    return counted(components(links).withColumnRenamed("node", "class"))[0]


def _extended(reach: DataFrame, proposed: tuple[DataFrame, int], *tables) -> tuple[DataFrame, int]:
    """The components (class, component) of reach and of those of the pairs that are similar, and how many these are. proposed: the pairs and their number; tables: what _confirmed takes besides."""
    pairs, n = proposed
    similar, many = _confirmed(pairs, *tables) if n else (None, 0)
    if not many:
        return reach, 0
    return _reached(reach.select(F.col("class").alias("a"), F.col("component").alias("b")).union(similar)), many


def few(ids: DataFrame) -> DataFrame:
    """ids, computed once; to be broadcast if they are not too many."""
    ids, n = counted(ids)
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _close(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that the fingerprints propose: classes of one fingerprint with the least of them, and those of fingerprints that the trie join links."""
    least, _ = counted(classes.groupBy("bits").agg(F.min("class").alias("head")))
    same = classes.join(least, "bits").where("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    ends = near_links(least.select("bits"), BUDGET).distinct()
    ends = ends.join(least.select(F.col("bits").alias("a"), F.col("head").alias("x")), "a").join(least.select(F.col("bits").alias("b"), F.col("head").alias("y")), "b")
    return same.union(ends.select(*_pair("x", "y")))


def _buckets(members: DataFrame) -> DataFrame:
    """(token, class, place) of the shingles that several classes hold, with their number and two of the classes, p and q, with their places."""
    member = F.struct(F.xxhash64("class").alias("turn"), "class", "place")
    named = ["token", "class", "place", "held", F.col("p.class").alias("p"), F.col("p.place").alias("p_place"), F.col("q.class").alias("q"), F.col("q.place").alias("q_place")]
    whole, bucket = (F.count("*"), F.min(member), F.max(member)), Window.partitionBy("token")
    rare = members.where("NOT common").drop("common").select("*", *(x.over(bucket).alias(name) for x, name in zip(whole, ("held", "p", "q"), strict=True)))
    common = members.where("common").drop("common")
    heads, _ = counted(common.groupBy("token").agg(*(x.alias(name) for x, name in zip(whole, ("held", "p", "q"), strict=True))).where("held > 1"))
    return rare.where("held > 1").select(*named).union(common.join(F.broadcast(heads), "token").select(*named))  # heads: MOST_COMMON at most


def _mixed(shared: DataFrame, reach: DataFrame, turn: int) -> DataFrame:
    """The members but the first two of buckets whose members are in several components: (token, class, place, component), the bucket's largest component `main`, and
    two members `head` (of that component) and `other`, which differ from turn to turn."""
    named = shared.where("held > 3 AND class <> p AND class <> q").select("token", "class", "place").join(reach, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    member = F.struct(F.xxhash64("class", F.lit(turn)).alias("turn"), "class", "place", "component")
    parts = named.groupBy("token", "component").agg(F.count("*").alias("n"), F.min(member).alias("head"))
    tops = parts.groupBy("token").agg(F.max_by("head", F.struct("n", "component")).alias("head"), F.min("head").alias("other"), F.count("*").alias("parts")).where("parts > 1")
    return counted(named.join(tops.select("token", "head", "other"), "token").withColumn("main", F.col("head.component")))[0]


def _likeliest(mixed: DataFrame, sketches: DataFrame) -> tuple[DataFrame, int]:
    """Pairs (a, b) of each class outside the main component of its buckets and that one of the buckets' heads and others whose sketch is nearest, and their number."""
    outside = mixed.where("component <> main")
    pairs = [
        outside.where(F.col("component") != F.col(f"{with_}.component")).where(_can_be(F.col("place"), F.col(f"{with_}.place"))).select("class", "place", F.col(f"{with_}.class").alias("with"), F.col(f"{with_}.place").alias("with_place"))
        for with_ in ("head", "other")
    ]
    pairs = pairs[0].union(pairs[1]).groupBy("class", "with").agg(F.first("place").alias("place"), F.first("with_place").alias("with_place"))
    pairs = pairs.join(sketches, "class").join(sketches.select(F.col("class").alias("with"), F.col("sketch").alias("with_sketch")), "with")
    pairs = pairs.where(_allowed("sketch", "with_sketch", "place", "with_place")).select("class", "with", _turned("sketch", "with_sketch").alias("turned"))
    return counted(pairs.groupBy("class").agg(F.min_by("with", F.struct("turned", "with")).alias("with")).select(*_pair("class", "with")).distinct())


def near_duplicates(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and component_id, the least id that can be reached by pairs of texts of similarity MOST / OF or more.

    The ids are distinct numbers; df is read several times and must give the same rows each time. Words are lower-cased in ASCII; texts without words (null ones too) are alike."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = written(_marks(texts, words), "marks")
    classes, _ = counted(marked.groupBy("high", "low").agg(F.min("id").alias("class"), *(F.first(x).alias(x) for x in ("bits", "n", "sketch", "wide"))))
    own = few(classes.select(F.col("class").alias("id")))
    sampled = few(classes.where(F.pmod("low", F.lit(SAMPLE_OF)) == 0).select(F.col("class").alias("id")))
    tokens, counts = (df.sparkSession.sparkContext.broadcast(x) for x in _common(_sets(texts.join(sampled, "id", "left_semi"), words)))

    rarest = _rarest(texts.join(own, "id", "left_semi"), words, tokens, counts)
    members = rarest.select(F.col("id").alias("class"), F.shiftleft(F.col("n").cast("long"), 32).alias("n"), "rare", F.posexplode("rarest").alias("at", "token"))
    members = members.select("token", "class", (F.col("n") + F.col("at")).alias("place"), (F.col("at") >= F.col("rare")).alias("common"))
    shared = written(_buckets(members), "buckets", compression="zstd")
    star = [
        shared.where(F.col("class") != F.col(pivot)).where(_can_be(F.col("place"), F.col(f"{pivot}_place"))).select("class", F.col(pivot).alias("with"))
        for pivot in ("p", "q")
    ]
    star = written(star[0].union(star[1]).groupBy("class", "with").agg(F.count("*").alias("n")), "stars")
    # First one partner of each class, that of most buckets, and what the fingerprints propose: most groups are connected by these.
    best = star.groupBy("class").agg(F.max_by("with", F.struct("n", "with")).alias("with")).select(*_pair("class", "with"))
    first, _ = counted(_close(classes.select("class", "bits")).union(best).distinct())
    reach = _reached(_confirmed(first, classes, texts, words)[0])
    # Then the other members of buckets with two of each, where they are still apart.
    of = lambda side: reach.select(F.col("class").alias(side), F.col("component").alias(f"{side}_of"))
    apart = star.select(*_pair("class", "with")).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    reach, _ = _extended(reach, counted(apart), classes, texts, words)
    # Then in rounds with one more member each, so that groups of near copies are connected before their pairs are listed.
    sketches = classes.select("class", "sketch")
    compared = 0
    for turn in range(ROUNDS):
        likeliest = _likeliest(_mixed(shared, reach, turn), sketches)
        compared = compared or likeliest[1]
        reach, many = _extended(reach, likeliest, classes, texts, words)
        if many * LEAST_FOUND <= compared:
            break

    # What all these don't connect: only pairs of different components, one of them not in the bucket's largest, that the sketches allow.
    mixed = _mixed(shared, reach, ROUNDS).select("token", "class", "place", "component", "main").join(sketches, "class")
    x, y = mixed.where("component <> main").alias("x"), mixed.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & _can_be(F.col("x.place"), F.col("y.place"))
    apart &= _allowed("x.sketch", "y.sketch", "x.place", "y.place")
    reach, _ = _extended(reach, counted(x.join(y, apart).select(*_pair("x.class", "y.class")).distinct()), classes, texts, words)
    named = classes.join(reach, "class", "left").select("high", "low", F.coalesce("component", "class").alias("component_id"))
    return marked.join(named, ["high", "low"]).select(F.col("id").alias(id_col), "component_id")
