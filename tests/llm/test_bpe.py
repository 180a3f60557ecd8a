import bisect
import base64
import hashlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeleaf.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "中", "😀", "'s", "12", "!!", "ing", "́", "<|endoftext|>", "\xa0", "\x00", "zzz"]) | st.text(max_size=5), max_size=30).map("".join))
def test_text_as_the_library_encodes_it(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(bpe.text_encoder(PATH, P.PATTERN).encode([text])[0], "<u4").tolist()
    assert got == reference.encode_ordinary(text)
    assert bpe.text_encoder(PATH, P.PATTERN).decode(np.array(got, "<u4").tobytes()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text("abe tion", max_size=60), st.text("abe tion", max_size=8), st.integers(0, 60), st.integers(0, 10))
def test_appends_and_edits_equal_a_fresh_encoding(text, new, at, cut):
    encoder = bpe.load_ranks(PATH)
    data = text.encode()
    state = bpe.PrefixState(encoder, data[: len(data) // 2])
    state.append(data[len(data) // 2 :])
    assert state.ids == encoder.encode_piece(data)
    at = min(at, len(data))
    state.replace(at, min(at + cut, len(data)), new.encode())
    assert state.ids == encoder.encode_piece(state.data)
    assert encoder.decode(state.ids) == state.data


def test_an_edit_of_a_long_piece_is_local():
    encoder = bpe.load_ranks(PATH)
    state = bpe.PrefixState(encoder, b"information" * 500)
    assert state.replace(20, 22, b"xy") < 1000
    assert state.ids == encoder.encode_piece(state.data)


def test_whole_table(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    ids = bpe.encode(docs, PATH, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in docs.collect()}


ODD = [(1, None, 7), (None, "", 7), (2, "one", 7), (2, "one", 7), (3, "word " * 40_000, 7), (4, "\n\n", 7)]


def test_nulls_empty_long_repeated_and_extra_columns(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.round_trip(df, PATH, P.PATTERN).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 40_001), (4, 1)]
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
    assert bpe.encode(df, PATH, P.PATTERN).where("doc_id = 1").first().ids == []


def test_token_counts_add_up_and_follow_the_rule(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = token_counts.attribute(docs, PATH, P.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sums = {}
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        assert r.char_end >= r.char_start
    assert sums == {i: len(reference.encode_ordinary(t)) for i, t in texts.items()}
    brute = {}
    for i, t in texts.items():
        starts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        character = [k for k, c in enumerate(t) for _ in c.encode()]  # of each byte
        at = 0
        for token in reference.encode_ordinary(t):
            section = bisect.bisect_right(starts, character[at]) - 1
            at += len(reference.decode_single_token_bytes(token))
            brute[i, section] = brute.get((i, section), 0) + 1
    assert {(r.doc_id, r.section): r.n_tokens for r in rows if r.n_tokens} == brute


def test_given_starts_are_sorted_and_held_to_the_text(spark):
    texts = [(1, "one two three", [5, 3]), (2, "one two", [4, None, 99, 99]), (3, "one", [-7, 2]), (4, "one", [None]), (5, None, [3, 9]), (6, "a\nb", [])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, at array<int>")
    for rule in token_counts.RULES:
        rows = token_counts.attribute(df, PATH, P.PATTERN, rule, starts_col="at").collect()
        assert sorted((r.doc_id, r.char_start, r.char_end) for r in rows) == [(1, 0, 5), (1, 5, 13), (2, 0, 7), (2, 7, 7), (2, 7, 7), (3, 0, 2), (3, 2, 3), (4, 0, 3), (5, 0, 0), (5, 0, 0), (6, 0, 2), (6, 2, 3)]
        sums = {}
        for r in rows:
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        assert all(sums[r.doc_id] == r.doc_tokens for r in rows)


def test_token_count_rules_and_given_sections(spark):
    starts, begin, end = np.array([0, 4, 6]), np.array([0, 2, 5]), np.array([2, 5, 9])
    assert token_counts.section_of(starts, begin, end, "first").tolist() == [0, 0, 1]
    assert token_counts.section_of(starts, begin, end, "last").tolist() == [0, 1, 2]
    assert token_counts.section_of(starts, begin, end, "most").tolist() == [0, 0, 2]
    df = spark.createDataFrame([(1, "one two three", [0, 3]), (2, None, [0]), (3, "a\nb", None)], "doc_id bigint, text string, at array<int>")
    got = sorted((r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens) for r in token_counts.attribute(df, PATH, P.PATTERN, "most", starts_col="at").collect())
    assert got == [(1, 0, 0, 3, 1), (1, 1, 3, 13, 2), (2, 0, 0, 0, 0), (3, 0, 0, 2, 2), (3, 1, 2, 3, 1)]
    assert token_counts.attribute(df.limit(0), PATH, P.PATTERN).count() == 0
