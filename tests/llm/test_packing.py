import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeleaf.llm import packing
from lakeleaf.llm.word_tokens import WordEncoder, word_encoder

PATH = P.path("word_bpe_49k.json")
PARTS = ["a", "The", "\n", " ", "  ", "\t", "é", "É", "中文", "😀", "'s", "'S", "1", "23", "!!", ".", ",", "...", "_", "ing", "́", "<|endoftext|>", "\xa0", "\x1c", "Σ", "İ", "\x00", "ǅ", "ﬁ", "क़"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_words_as_the_library_encodes_them(text):
    encoder = word_encoder(PATH)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_full_stores_are_handed_over(monkeypatch):
    from lakeleaf.llm import word_tokens

    monkeypatch.setattr(word_tokens, "KEPT_WORDS", 20)
    encoder = WordEncoder(PATH)
    for i in range(30):
        text = " ".join(f"{c}{d} {c * 3}" for c in "abcdefg" for d in range(i, i + 3)) + " " + "x" * 100
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_a_run_of_marks_keeps_no_other_words_whole():
    encoder = WordEncoder(PATH)
    texts = ["one. two, three... four.\tfive ,.x, six.", "", "... seven,", "eight,..", "\n"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids
    assert {"three...", ",.x,", "eight,.."} <= encoder.kept.keys() and not {"one.", "two,", "four.", "six.", "seven,"} & encoder.kept.keys()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packer_loses_nothing_and_pads_nothing(lengths):
    packer, ids = packing.Packer(16), {k: np.arange(1000 * k, 1000 * k + n, dtype="<u4").tobytes() for k, n in enumerate(lengths)}
    found = [x for k, n in enumerate(lengths) for x in packer.put(k, ids[k], n)]
    assert all(int(packer.levels[h]) == len(packer.open[h]) for h in range(16))
    found += packer.finish()
    sequences, docs = defaultdict(list), defaultdict(list)
    for number, offset, key, start, data, total in found:
        assert total == lengths[key]
        sequences[number].append((offset, len(data) // 4))
        docs[key].append((start, data))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 16 and (at & (at - 1)) == 0
    assert {k: b"".join(d for _, d in sorted(v)) for k, v in docs.items()} == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=40))
def test_level_is_the_one_of_least_squares(lengths):
    packer = packing.Packer(16)
    for k, n in enumerate(lengths):
        level = packer.level_for(n)
        costs = {}
        for h in range(0, 16 - n + 1):
            if h == 0 or packer.levels[h]:
                after = packer.levels.copy()
                after[h] -= h > 0
                if h + n < 16:
                    after[h + n] += 1
                costs[h] = int((after**2).sum())
        assert costs[level] == min(costs.values())
        list(packer.put(k, b"\0\0\0\0" * n, n))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    model = Tokenizer.from_file(PATH)
    want = {r.doc_id: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    got, sequences = defaultdict(int), defaultdict(list)
    for r in packing.pack(docs, PATH).collect():
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(want[r.doc_id]) and len(piece) == r.length
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == {i: len(x) for i, x in want.items()}
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths)
    assert sum(n < 2048 for n in lengths) <= 3 * 11


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (None, "", 7), (2, "one", 7), (2, "one", 7), (3, "word " * 30_000, 7)], "doc_id bigint, text string, length int")
    rows = packing.pack(df.coalesce(1), PATH, with_ids=True).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 2 + 2 + 30_001 and all(len(r.ids) == r.length for r in rows)
    assert packing.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(9, 40), min_size=30, max_size=200), st.integers(2, 12))
def test_open_sequences_are_bounded(lengths, most):
    packer, ids, found = packing.Packer(16), {}, []
    before, packing.MOST_OPEN = packing.MOST_OPEN, most
    try:
        for k, n in enumerate(lengths):
            ids[k] = np.arange(1000 * k, 1000 * k + n, dtype="<u4").tobytes()
            found += packer.put(k, ids[k], n)
            assert packer.held == sum(map(len, packer.open)) == packer.levels.sum() <= most and packer.levels[0] == 0
        found += packer.finish()
    finally:
        packing.MOST_OPEN = before
    sequences, docs = defaultdict(int), defaultdict(list)
    for number, offset, key, start, data, _ in sorted(found, key=lambda x: x[:2]):
        assert offset == sequences[number]
        sequences[number] += len(data) // 4
        docs[key].append((start, data))
    assert {k: b"".join(d for _, d in sorted(v)) for k, v in docs.items()} == ids
    assert all(n == 16 or n & (n - 1) == 0 for n in sequences.values()) and sum(n < 16 for n in sequences.values()) <= 4


def test_special_tokens_that_a_text_spells(spark):
    df = spark.createDataFrame([(1, "hello <|endoftext|> world<|startoftext|>x, <|EndOfText|>.")], "doc_id bigint, text string")
    model = Tokenizer.from_file(PATH)
    want = [*model.encode(df.first().text, add_special_tokens=False).ids, 1]
    got = [i for r in packing.pack(df, PATH, with_ids=True).orderBy("start").collect() for i in r.ids]
    assert want[:3] == [3306, 49407, 1002] and got == want
