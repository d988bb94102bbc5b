"""Encoding by pieces equals encoding at once; packing places every token once."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cratewave.llm import packing, tokens

ENC = tokens.encoder()
ALPHABETS = ["abc", "ab c'", "aé日本 \n", "0123456789", "    \t", "!?-'s", "aA1! ", "日本語", "'s't"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("leaf", [64, 257])
def test_pieces_equal_whole(alphabet, leaf):
    rng = random.Random(len(alphabet) * leaf)
    for n in (0, 1, leaf, leaf + 1, 5 * leaf, 12 * leaf + 3):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert tokens.encode_text(ENC, text, leaf).tolist() == ENC.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400), st.integers(16, 64))
def test_any_text(text, leaf):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode_text(ENC, text, leaf).tolist() == ENC.encode_ordinary(text)


def test_one_letter_runs():
    for text in ("a" * 5000, " " * 3000 + "x", "x" + "\n" * 2000, "ab" * 3000, "'" * 1500 + "s" * 1500):
        assert tokens.encode_text(ENC, text, 128).tolist() == ENC.encode_ordinary(text)


def test_corpus(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello  world", "x"), (4, "naïve " * 200, "x"), (5, "z" * 3000, "x"), (6, "<|endoftext|>", "x"), (7, "z" * 3000, "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, leaf=300).collect()}
    assert got == {k: ENC.encode_ordinary(t) if t else [] for k, t, _ in rows}
    counts = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, leaf=300, count_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(df.limit(0)).collect() == []


def test_repeated_long_rows(spark):
    df = spark.createDataFrame([(1, "w" * 900), (1, "w" * 900), (2, "v" * 900)], "doc_id bigint, text string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode_corpus(df, leaf=100).collect())
    assert got == sorted((k, tuple(ENC.encode_ordinary(t))) for k, t in ((1, "w" * 900), (1, "w" * 900), (2, "v" * 900)))


def fits(rows, sizes, capacity):
    seen, room = {}, {}
    for r in rows:
        assert 0 < r.n_tokens <= capacity and r.container_offset >= 0 and r.container_offset + r.n_tokens <= capacity
        room.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
        seen.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    for parts in room.values():
        end = 0
        for start, n in sorted(parts):
            assert start >= end
            end = start + n
    for k, n in sizes.items():
        parts = sorted(seen.pop(k, []))
        assert sum(m for _, m in parts) == n and (n > capacity or len(parts) <= 1)
        at = 0
        for start, m in parts:
            assert start == at
            at += m
    assert not seen
    return len(room)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = {i: (17 if rng.random() < 0.4 else int(rng.lognormvariate(3, 1.2))) for i in range(800)} | {900: 0}
    df = spark.createDataFrame([*sizes.items(), (901, None)], "doc_id bigint, n_tokens int")
    for limit, capacity in ((1, 64), (2, 300), (3, 1)):
        rows = packing.pack(df, [(limit, capacity)], salts=8).collect()
        used = fits(rows, sizes, capacity)
        assert used <= 1.05 * sum(sizes.values()) / capacity + 2
    both = packing.pack(df, [(1, 64), (2, 300), (4, None), (5, -1)], salts=8)
    assert {r.limit_id for r in both.collect()} == {1, 2}


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens int")
    assert packing.pack(empty, [(1, 10)]).count() == 0 and packing.pack(empty, []).count() == 0
    one = spark.createDataFrame([(5, 25)], "doc_id bigint, n_tokens int")
    assert sorted((r.piece, r.token_start, r.n_tokens) for r in packing.pack(one, [(1, 10)]).collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_all(counts):
    entries, n = packing.plan(50, counts)
    room = [0] * n
    placed = {}
    for length, rank, used, each, first, offset in entries:
        assert rank == placed.get(length, 0)
        placed[length] = rank + used * each
        for c in range(first, first + used):
            assert room[c] == offset
            room[c] += each * length
    assert {k: placed.get(k, 0) for k in counts} == counts and all(0 < r <= 50 for r in room)


def test_a_capacity_that_is_too_large_is_told(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens int")
    with pytest.raises(ValueError):
        packing.pack(sizes, [(1, 10), (2, packing.MAX_CAPACITY + 1)])
    assert packing.pack(sizes, [(1, packing.MAX_CAPACITY), (2, 0)]).count() == 1
