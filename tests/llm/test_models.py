import math
import os
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeleaf.llm import language, toxicity
from lakeleaf.llm.runtime import smallest

#: The folder of the tables of all sizes.
DATA = os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/"))


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()}
    rows = [r for r in docs.collect() if out(r.doc_id) and r.lang]
    assert sum(found[r.doc_id][0] == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= s <= 1 for _, s in found.values())


def test_language_families_duels_and_odd_rows(spark):
    texts = {"en": "the and with this that", "de": "der und mit nicht schön", "nl": "het een van niet zijn", "es": "el los para con niño", "xx": "qqq zzz kkk www"}
    rows = [(i, f"{t} {i}", lang) for k, (lang, t) in enumerate(texts.items()) for i in range(100 * k, 100 * k + 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert len(model.within) == 3
    names, scores = model.predict([*texts.values(), "", "12 !!", "x" * 300_000])
    assert names[:5] == list(texts) and names[5:7] == ["und", "und"] and scores[5:7].tolist() == [0, 0]
    odd = spark.createDataFrame([(1, None, "en", 1), (None, "the with", None, 1), (2, "", "en", 1), (2, "", "en", 1)], "doc_id bigint, text string, lang string, score int")
    got = sorted(((r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()), key=str)
    assert got == [(1, "und"), (2, "und"), (2, "und"), (None, "en")]
    assert language.identify(odd, language.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(odd, model).count() == 1
    assert language.identify(odd.limit(0), model).count() == 0


def test_no_label_is_learned_from_held_out_rows(spark):
    rows = [(i, "aaa bbb" if out(i) else "ccc ddd", "en" if out(i) else "fr") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(model.predict(["aaa bbb", "ccc ddd"])[0]) == {"fr"}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    rows = [r for r in labels.collect() if out(r.doc_id)]
    hit = [found[r.doc_id] for r in rows if r.toxic]
    clean = [found[r.doc_id] for r in rows if not r.toxic]
    assert sum(hit) / len(hit) > 0.9 and sum(clean) / len(clean) < 0.01


def test_subwords_share_buckets_with_misspellings():
    def bag(word):
        return set(toxicity.subwords([word])[1].tolist())

    assert len(bag("worthless") & bag("worthlesss")) > 0.6 * len(bag("worthless"))
    together = toxicity.subwords(["idiot", "clown", "a"])
    assert {b for o, b in zip(*together, strict=True) if o == 1} == bag("clown") and bag("a")


def test_toxicity_of_odd_rows_and_single_classes(spark):
    docs = spark.createDataFrame([(i, "you nasty fool" if i % 2 else "a fine day", 1) for i in range(80)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None), (3, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "12 --"), (3, "you nasty fool " * 20_000), (3, "a fine day")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.predicted) for r in toxicity.score(odd, model).collect()), key=str)
    assert got == [(1, 0), (2, 0), (3, 0), (3, 1), (None, 0)]
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.keep_clean(odd, model).count() == 4 and toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, none).where("predicted = 1").count() == 0


def plain_duels(duels, x):
    """The winner and its confidence, one pair of names after another."""
    wins, total, worst = Counter(), Counter(), {}
    for k, (a, b) in enumerate(combinations(range(len(duels.names)), 2)):
        margin = sum(v * float(duels.weights[k][i]) for i, v in x.items()) + float(duels.bias[k])
        for name, m in ((a, margin), (b, -margin)):
            wins[name] += m > 0
            total[name] += m
            worst[name] = min(worst.get(name, math.inf), m)
    best = max(range(len(duels.names)), key=lambda n: (wins[n], total[n], -n))
    return best, 1 / (1 + math.exp(-3 * worst[best])) if len(duels.names) > 1 else 1.0


def plain_language(model, text):
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    data = b" " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b"  "
    grams = [data[i : i + 3] for i in range(len(data) - 2) if data[i + 1] != 32]
    counts = Counter((int.from_bytes(g, "big") * 2654435761 % 2**32) >> 19 for g in grams)
    x = {i: math.sqrt(n / len(grams)) for i, n in counts.items()}
    family, sure = plain_duels(model.families, x)
    own, inner = plain_duels(model.within[family], x)
    return model.within[family].names[own], sure * inner


def test_languages_as_a_plain_scorer_tells_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    want = {r.doc_id: plain_language(model, r.text or "") for r in docs.collect()}
    for r in language.identify(docs, model).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-4)


def test_machines_separate_what_is_separable():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) + np.where(np.arange(60) % 2, 4, -4)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    weights, bias = language.support_vectors(x.astype(np.float32), np.arange(60) % 2 == 1, cost=1e4, epochs=500)
    margin = np.where(np.arange(60) % 2, 1, -1) * (x @ weights + bias)
    assert margin.min() > 0.98 and margin.min() < 1.02  # the closest ones lie on the margin


def plain_toxicity(model, text):
    total, number, tokens = 0.0, 0, text.lower().split()
    for token in tokens:
        word = "".join(c for c in token if c.isalpha())
        if not word:
            continue
        marked = [ord(c) for c in f"<{word}>"]
        for n in toxicity.ORDERS:
            for i in range(len(marked) - n + 1):
                mixed = 0
                for c in marked[i : i + n]:
                    mixed = (mixed * 1_000_003 + c) % 2**64
                total += float(model.part[(mixed + n) * 0x9E3779B97F4A7C15 % 2**64 >> 47])
                number += 1
        whole = 0
        for place, c in enumerate(marked):
            v = (c + 1) * 0x9E3779B97F4A7C15 % 2**64 * (place * 0xC2B2AE3D27D4EB4F % 2**64 | 1) % 2**64
            whole = (whole + (v ^ v >> 29)) % 2**64
        total += float(model.part[whole * 0x9E3779B97F4A7C15 % 2**64 >> 47])
        number += 1
    wide = 1 + toxicity.PRIOR / max(1, len(set(tokens)))
    logit = total / max(number * wide, 1) + model.bias if number else min(model.bias, -4.0)
    return 1 / (1 + math.exp(-max(-40, min(40, logit))))


def test_toxicity_as_a_plain_scorer_tells_it(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    some = docs.where("length(text) < 4000 OR text IS NULL")
    want = {r.doc_id: plain_toxicity(model, r.text or "") for r in some.collect()}
    for r in toxicity.score(some, model).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5) and r.predicted == (r.score >= 0.5)


def test_samples_are_the_smallest_hashes_and_bounded(spark):
    rows = [(k, (i * 7919) % 10_007) for k in "ab" for i in range(3000)] + [("a", 5)] * 500
    got = smallest(spark.createDataFrame(rows, "k string, turn bigint"), "k", "turn", 40).collect()
    want = {(k, t) for k in "ab" for t in sorted({t for c, t in rows if c == k})[:40]}
    assert {tuple(r) for r in got} == want and len(got) == 80
    # One id with very many texts, and one text repeated very often, teach no more than the limit.
    docs = spark.createDataFrame([(1, f"bad word {i}") for i in range(300)] + [(2, "fine day")] * 300 + [(3, "x" * 50)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    seen = []
    before = toxicity.Model
    toxicity.Model = lambda texts, toxic: seen.append(list(zip(texts, toxic, strict=True)))
    try:
        toxicity.fit(docs, labels, train_rows=20, train_chars=40)
    finally:
        toxicity.Model = before
    assert Counter(y for _, y in seen[0]) == {1: 20, 0: 1}
