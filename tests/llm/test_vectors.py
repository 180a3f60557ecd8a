import numpy as np
from pyspark.sql import functions as F

from lakeleaf.llm import embedding_dedup, topk

NAN, INF = float("nan"), float("inf")


def brute_topk(rows, k, every):
    z = [(i, [int(np.floor(1024 * np.float64(v))) for v in x]) for i, x in rows if x and all(v is not None and np.isfinite(v) for v in x)]
    out = set()
    for n, (i, q) in enumerate(z):
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, c, strict=False)), j) for m, (j, c) in enumerate(z) if m != n))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_topk_of_the_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {tuple(r) for r in topk.search(df).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_topk([(r.vec_id, r.embedding) for r in df.collect()], 10, 100)


def test_topk_in_small_blocks_ties_and_odd_rows(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 3), ("CANDIDATE_BLOCK", 7), ("ROUND", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4) / 4]) for i in range(0, 60, 3)] + [(200, None), (300, []), (400, [1.0, None]), (500, [NAN]), (600, [INF, 1.0]), (700, [0.5, 0.25]), (900, [0.0] * 6)]
    df = spark.createDataFrame([(i, x, "x") for i, x in rows], "vec_id bigint, embedding array<double>, score string")
    got = {tuple(r) for r in topk.search(df, 5, 2).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_topk(rows, 5, 2)
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id = 0")).count() == 0
    big = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [-3e5, 1e300])], "vec_id bigint, embedding array<double>")
    assert {(r.rank, r.vec_id) for r in topk.search(big).where("query_id = 0").collect()} == {(1, 2), (2, 1)}


def test_most_candidates_are_not_evaluated():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 500
    vectors = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8)) * 5)
    pivots = topk.choose_pivots(vectors[::7], 16)
    table, ids = topk.pivot_distances(vectors, pivots), np.arange(2000)
    low = np.abs(table - table[5]).max(1)
    bound = ((vectors[5] ** 2).sum() + (vectors**2).sum(1) - low**2) / 2 + 1
    (places, scores), evaluated = topk.best_of_block(vectors[5], 5, vectors, ids, ids, bound, 10, True)
    want = np.lexsort((ids[ids != 5], -(vectors @ vectors[5])[ids != 5]))[:10]
    assert places.tolist() == ids[ids != 5][want].tolist() and evaluated < 1000


def brute_dedup(rows, threshold=0.93):
    good = [(i, np.array(x, float), label) for i, x, label in rows if i is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    n = len(good)
    root, links = list(range(n)), [0] * n

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    least = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), good[a][0]), good[a][0])
    linked = {}
    for a in range(n):
        linked.setdefault(good[a][0], []).append((links[a], least[find(a)]))
    return linked


def test_dedup_with_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "ROWS_A_LIST", 8)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=10)
        rows += [(len(rows) + k, [float(v) for v in centre + rng.normal(size=10) * rng.choice([0.02, 0.12, 0.3])], c % 3) for k in range(25)]
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(20)] + [(1100, rows[7][1], None), (1200, None, 1), (1300, [0.0] * 10, 1), (1400, [NAN] * 10, 1), (1500, [1.0, None], 1), (1600, [], 1), (1700, [1.0] * 3, 1)]
    df = spark.createDataFrame([(i, x, label, 1) for i, x, label in rows], "vec_id bigint, embedding array<double>, label int, n_links int")
    got = embedding_dedup.near_duplicates(df).collect()
    want = brute_dedup(rows)
    assert len(got) == len(rows)
    for r in got:
        links, component = want.get(r.vec_id, [(0, r.vec_id)])[0]
        assert (r.n_links, r.component_id, r.kept) == (links, component, component == r.vec_id)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []
    assert {tuple(r) for r in embedding_dedup.near_duplicates(df.where("label IS NULL")).collect()} == {(1100, 0, 1100, True)}


def test_dedup_of_the_whole_table_misses_no_link(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    near = df.where("vec_id % 3 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda v, i: (v + F.when(i == 3, 0.2).otherwise(0.0)).cast("float")).alias("embedding"), "label")
    df = df.union(near)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute_dedup([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert got == {i: v[0] for i, v in want.items()}


def test_dedup_links_vectors_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "ROWS_A_LIST", 8)
    rng = np.random.default_rng(5)
    rows = []
    for c, width in enumerate((10, 6, 10, 6, 10, 3)):
        centre = rng.normal(size=width)
        rows += [(len(rows) + k, [float(v) for v in centre + rng.normal(size=width) * rng.choice([0.02, 0.12, 0.3])], c % 2) for k in range(20)]
    rows += [(900, rows[25][1], rows[25][2]), (901, rows[25][1] + [0.0], rows[25][2]), (902, [2.0], 1), (903, [1.0], 1), (904, [-1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = {i: v[0] for i, v in brute_dedup(rows).items()}
    for train in (20_000, 0):
        monkeypatch.setattr(embedding_dedup, "TRAIN_ROWS", train)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
        assert got == want and got[900][0] > 0 and got[903] == (1, 902) and got[901] == (0, 901)


def test_dedup_of_very_large_and_very_small_numbers(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [3.0, 3.0], 1), (4, [1e200, -1e200], 1), (5, [5e-324, 0.0], 1), (6, [0.0, -0.0], 1), (7, [-1e308, 1e308], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_dedup_recall_with_many_lists(spark, monkeypatch):
    """Links of just the threshold between evenly spread vectors: the hardest for lists."""
    monkeypatch.setattr(embedding_dedup, "ROWS_A_LIST", 32)
    rng = np.random.default_rng(3)
    x = embedding_dedup.units(rng.normal(size=(1500, 64)))
    d = rng.normal(size=x.shape)
    d = embedding_dedup.units(d - (d * x).sum(1)[:, None] * x)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * d
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((x, y)))]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    u = embedding_dedup.units(np.concatenate((x, y)))
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert want.sum() >= 3000 and sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= n for i, n in enumerate(want.tolist()))
