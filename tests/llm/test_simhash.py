import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeleaf.llm import components as module_of_components
from lakeleaf.llm import runtime, simhash
from lakeleaf.llm.components import components


def brute_fingerprint(text, k=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits, budget=3):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(bits, "u8")
    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bits = [brute_fingerprint(t) for _, t in rows]
    want = {d: (f"{b:016x}", rows[c][0]) for (d, _), b, c in zip(rows, bits, brute_components(bits), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def _clustered(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    found = {0, (1 << 64) - 1}
    for _ in range(500):
        x = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found)


def test_links_of_clusters_with_and_without_dealing_hot_buckets(spark, monkeypatch):
    for budget in (1, 3, 4):
        bits = _clustered(budget)
        want = brute_components(bits, budget)
        signed = {int(np.array(b, "u8").view("i8")): b for b in bits}
        df = spark.createDataFrame([(x,) for x in signed], "bits bigint")
        for hot, gathered in ((20_000, 50_000), (3, 50_000), (20_000, 7)):
            monkeypatch.setattr(simhash, "GATHERED", gathered)
            links = [(signed[r.a], signed[r.b]) for r in simhash.near_links(df, budget, hot).collect()]
            assert all((a ^ b).bit_count() for a, b in links)
            at = {b: i for i, b in enumerate(bits)}
            root = list(range(len(bits)))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                x, y = find(at[a]), find(at[b])
                root[max(x, y)] = min(x, y)
            assert [find(i) for i in range(len(bits))] == want


def test_nulls_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(5, None, 1), (3, "", 1), (4, " \t ", 1), (9, "one", 1), (9, "one", 1), (None, "ONE", 1), (7, "a " * 50_000, 1)], "doc_id bigint, text string, component_id int"
    )
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    one = f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, "0" * 16, 3), (4, "0" * 16, 3), (5, "0" * 16, 3)]
    assert [x for x in got if x[1] == one] == [(9, one, 9), (9, one, 9), (None, one, 9)]
    assert simhash.near_duplicates(df.where("doc_id > 100")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, i) for i in range(1, 40)] + [(7000, 7000), (8000, 8001), (8001, 8000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in path} | {i: 1 for i in [1000, *range(1, 40)]} | {8000: 8000, 8001: 8000}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


@pytest.mark.parametrize("gathered,most", [(3, 10**6), (10**6, 150)])
def test_few_links_in_many_partitions_take_few_tasks(spark, monkeypatch, gathered, most):
    monkeypatch.setattr(module_of_components, "GATHERED", gathered)
    edges = spark.range(0, 400, 1, 40).select(((F.col("id") * 7) % 401).alias("a"), ((F.col("id") * 7 + 7) % 401).alias("b"))  # one path of 401 nodes
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    sc.setJobGroup(f"links-{gathered}", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(401)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(f"links-{gathered}") for s in tracker.getJobInfo(j).stageIds}
    assert 40 <= sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s))) < most


def test_counted_tables_keep_their_rows_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(runtime, "PART_ROWS", 100)
    for rows, parts in ((0, 1), (100, 1), (250, 3)):
        kept, n = runtime.counted(spark.range(0, rows, 1, 40))
        assert n == rows and kept.rdd.getNumPartitions() == parts and sorted(r.id for r in kept.collect()) == list(range(rows))
