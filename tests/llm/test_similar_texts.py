import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lakeleaf.llm import runtime, similar_texts


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[find(i)][0] for i in range(len(rows))], pairs


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def varied(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    texts = [None, "", " \n", "One", "one ", "one two three four", "one two three four five", "a " * 300, "a " * 400]
    for c in range(12):
        base = [f"c{c}v{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 150]))] + (passage if c % 2 else [])
        now = base
        for _ in range(30 if c == 3 else 8):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 5]))))
            now = edited(rng, now, 1)  # a path of small steps
            texts.append(" ".join(now))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,least", [(1, 3), (2, 10_000), (3, 1)])
def test_no_pair_of_similarity_four_fifths_is_missed(spark, monkeypatch, seed, least):
    monkeypatch.setattr(similar_texts, "SAMPLE_OF", 2)
    monkeypatch.setattr(similar_texts, "LEAST_COMMON", least)
    rows = varied(seed)
    got = {r.doc_id: r.component_id for r in similar_texts.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)).collect()}
    want, pairs = brute(rows)
    assert pairs > 200 and [got[i] for i, _ in rows] == want


def test_near_duplicate_stage_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == set(brute(rows)[0])


def test_near_copies_beyond_three_bits_go(spark, sf_dir):
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    copy = list(base)
    copy[60], copy[130] = "x", "y"
    docs = spark.createDataFrame([(2, " ".join(copy)), (1, " ".join(base)), (3, " ".join(edited(rng, base, 30)))], "doc_id bigint, text string")
    assert [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 3]


def test_pairs_of_a_group_of_near_copies_are_not_all_compared(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "SAMPLE_OF", 2)
    compared, confirmed = [], similar_texts._confirmed
    monkeypatch.setattr(similar_texts, "_confirmed", lambda pairs, *rest: compared.append(pairs.count()) or confirmed(pairs, *rest))
    rng = random.Random(6)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.choice([2, 2, 3]))) for _ in range(300)))
    got = {r.doc_id: r.component_id for r in similar_texts.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)).collect()}
    want, _ = brute(rows)
    assert len(set(want)) > 50 and [got[i] for i, _ in rows] == want
    assert sum(compared) < 8 * len(rows)


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = random.Random(7)
    for n in (1, 30, 600, 3000):
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        x, y = (similar_texts.shingles(" ".join(t)) for t in (words, edited(rng, words, n // 20 + 1)))
        apart = int(np.bitwise_count((similar_texts.sketch(x) ^ similar_texts.sketch(y)).view("<u8")).sum())
        assert 0 < apart <= len(np.setxor1d(x, y)) and not len(np.setxor1d(x, x)) and len(similar_texts.sketch(x)) * 64 == similar_texts.SKETCH


def test_wide_sketches_differ_in_no_more_bits_than_the_sets_in_shingles(spark):
    rng = random.Random(8)
    rows = []
    for n in (1, 500, 516, 517, 1028, 1029, 3000):
        words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for m in (n, n - n // 9, n + n // 9):
            x, y = (similar_texts.shingles(" ".join(t)) for t in (words, edited(rng, (words + words[:m])[:m] if m <= n else words + [f"u{i}" for i in range(m - n)], n // 40)))
            rows.append((len(np.setxor1d(x, y)), similar_texts.wide_sketch(x).tolist(), similar_texts.wide_sketch(y).tolist()))
            assert 64 * len(rows[-1][1]) >= max(len(x), similar_texts.SKETCH)
    found = spark.createDataFrame(rows, "n int, x array<bigint>, y array<bigint>").select("n", similar_texts._wide_turned("x", "y").alias("turned")).collect()
    assert len({len(x) - len(y) for _, x, y in rows}) > 1
    assert not [r for r in found if not 0.5 * min(r.n, 200) - 5 <= r.turned <= r.n]


def test_of_long_texts_that_only_look_alike_no_sets_are_moved(spark, monkeypatch):
    made, sets = [], similar_texts._sets
    monkeypatch.setattr(similar_texts, "_sets", lambda df, words: made.append(df.count()) or sets(df, words))
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**5)}" for _ in range(2500)]
    rows = list(enumerate(" ".join(edited(rng, base, 100)) for _ in range(30)))  # three quarters or so of their shingles in common
    rows += [(100, " ".join(base[:1500])), (101, " ".join(edited(rng, base[:1500], 20)))]
    got = {r.doc_id: r.component_id for r in similar_texts.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)).collect()}
    want, _ = brute(rows)
    assert len(set(want)) == 31 and [got[i] for i, _ in rows] == want
    assert sum(made[1:]) <= 4  # made[0]: the sample


def test_kept_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {name for name in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())) if name.startswith("shuffle_")}
    before = held()
    table = spark.range(5_000).repartition(7).groupBy((F.col("id") % 900).alias("k")).count()
    kept, n = runtime.counted(table)
    found = runtime.written(table.join(kept.select("k"), "k"), "joined")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and n == 900 and kept.count() == 900 and found.count() == 900 and table.count() == 900
