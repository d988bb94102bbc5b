"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: tree concatenation. A text of up to `leaf` code points is encoded in one call. A longer one is cut into pieces
that are encoded in parallel and concatenated again as a binary tree. A cut is *hard* where the tokenizer's pattern is
sure to end a word (before a blank after a non-blank, between letters and digits, and so on), so that both sides may
simply be appended. In a run of one character class (a megabyte of letters, of digits, of blanks) no such place exists
and the cut is *soft*: windows around the join are encoded again and grow until the first tokens of the window equal
the left side's and the last tokens the right side's. Two neighbouring tokens that occur in one canonical encoding may
always stand side by side, so from there on the concatenation is the encoding of the whole.

Null and empty texts give an empty list of ids.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
LEAF = 32_768
#: Fixed value: the pattern that the public rank files are used with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(directory: str = TOKENIZERS, name: str = VOCABULARY):
    """The encoder of a rank file; once per Python process."""
    import tiktoken

    with open(f"{directory}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    """Character class of the pattern: letter, number, space or other."""
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "s"
    major = unicodedata.category(c)[0]
    return major if major in "LN" else "o"


def _is_hard(before: str, after: str) -> bool:
    """Whether the pattern ends a word between two characters, whatever surrounds them."""
    a, b = _kind(before), _kind(after)
    return (b == "s" and a != "s") or (a in "LN" and b != a) or (a == "o" and b == "N")


def cut(text: str, leaf: int = LEAF) -> list[tuple[int, bool]]:
    """Starts of the pieces of a text, each with whether the cut before it is soft."""
    starts, at = [(0, False)], 0
    while len(text) - at > leaf:
        end, low = at + leaf, at + leaf // 2
        here = next((i for i in range(end, low, -1) if _is_hard(text[i - 1], text[i])), None)
        soft = here is None
        if soft:
            # the half holds at most one change of class, from other to letters: cut inside the longer stretch
            change = next((i for i in range(low + 1, end) if _kind(text[i - 1]) != _kind(text[i])), None)
            if change is None:
                here = (low + end) // 2
            else:
                here = (low + change) // 2 if change - low > end - change else (change + end) // 2
            while here > low + 1 and text[here] == "'":
                here -= 1
        starts.append((here, soft))
        at = here
    return starts


def join(enc, left: np.ndarray, right: np.ndarray, agree: int = 2) -> np.ndarray:
    """Tokens of two pieces of one run, by encoding growing windows around the join again."""
    width = 16
    while True:
        a, b = left[-width:], right[:width]
        if len(a) < len(left) and len(b) < len(right):
            data = b"".join(enc.decode_single_token_bytes(int(t)) for t in (*a, *b))
            kinds = None
            try:
                kinds = {_kind(c) for c in data.decode("utf-8", "ignore")}
            except UnicodeError:  # pragma: no cover - ignore never raises
                pass
            if kinds is not None and len(kinds) == 1:  # the window lies inside one word of the pattern
                window = np.array(enc._encode_single_piece(data), dtype=np.int32)
                if len(window) >= 2 * agree and (window[:agree] == a[:agree]).all() and (window[-agree:] == b[-agree:]).all():
                    return np.concatenate([left[:-width], window, right[width:]])
                width *= 2
                continue
        # the window has reached the end of a run or of a piece: both pieces are encoded as one
        data = b"".join(enc.decode_single_token_bytes(int(t)) for t in (*left, *right))
        return np.array(enc.encode_ordinary(data.decode("utf-8")), dtype=np.int32)


def concatenate(enc, parts: list[tuple[bool, np.ndarray]]) -> np.ndarray:
    """The tree over the pieces of a text; `soft` of a piece tells of the cut before it."""
    if len(parts) == 1:
        return parts[0][1]
    # soft joins first, so that every side of a hard join is final
    half = len(parts) // 2
    left, right = concatenate(enc, parts[:half]), concatenate(enc, parts[half:])
    return join(enc, left, right) if parts[half][0] else np.concatenate([left, right])


def encode_text(enc, text: str | None, leaf: int = LEAF) -> np.ndarray:
    """The ids of one text, by the same pieces and joins as the distributed operator."""
    if not text:
        return np.empty(0, np.int32)
    starts = cut(text, leaf)
    ends = [s for s, _ in starts[1:]] + [len(text)]
    return concatenate(enc, [(soft, np.array(enc.encode_ordinary(text[s:e]), np.int32)) for (s, soft), e in zip(starts, ends)])


def encode_corpus(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", directory: str = TOKENIZERS, name: str = VOCABULARY,
    leaf: int = LEAF, count_only: bool = False,
) -> DataFrame:
    """One row per row of `docs`: `key` and `ids` (array<int>), or `n_tokens` with `count_only`.

    Null and empty texts: an empty list, 0 tokens. Rows with the same key are kept apart as long as their texts fit one
    leaf; longer texts of one key are told apart by their content. Other columns are dropped. Texts of up to `leaf` code
    points are encoded where they are read, without a shuffle; only the pieces of longer ones are spread.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    key_type = rows.schema["k"].dataType.simpleString()
    long = F.coalesce(F.length("t"), F.lit(0)) > leaf
    out = "n_tokens int" if count_only else "ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [enc.encode_ordinary(t) if t else [] for t in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                if count_only:
                    value = pa.array(lengths)
                else:
                    values = pa.array(np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum())))
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), value], ["k", out.split()[0]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, h in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                starts = cut(t, leaf)
                ends = [s for s, _ in starts[1:]] + [len(t)]
                for n, ((s, soft), e) in enumerate(zip(starts, ends)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()], batch.schema.field(0).type), pa.array([h.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([soft]), pa.array([t[s:e]], pa.string())],
                        ["k", "h", "n", "soft", "t"],
                    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, name)
        for batch in batches:
            ids = [np.array(enc.encode_ordinary(t), np.int32).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["k", "h", "n", "soft", "ids"])

    def together(group: pa.Table) -> pa.Table:
        enc = encoder(directory, name)
        group = group.sort_by("n")
        parts = [(s, np.frombuffer(b, np.int32)) for s, b in zip(group["soft"].to_pylist(), group["ids"].to_pylist())]
        copies = group["n"].to_pylist().count(0)
        ids = concatenate(enc, parts[::copies])
        value = pa.array([len(ids)] * copies, pa.int32()) if count_only else pa.array([ids] * copies, pa.list_(pa.int32()))
        return pa.table([group["k"].combine_chunks().slice(0, copies), value], ["k", out.split()[0]])

    short = rows.where(~long).mapInArrow(whole, f"k {key_type}, {out}")
    cuts = rows.where(long).withColumn("h", F.xxhash64("t")).mapInArrow(pieces, f"k {key_type}, h bigint, n int, soft boolean, t string")
    encoded = cuts.repartition("k", "h", "n").mapInArrow(encode_pieces, f"k {key_type}, h bigint, n int, soft boolean, ids binary")
    joined = encoded.groupBy("k", "h").applyInArrow(together, f"k {key_type}, {out}")
    return short.unionByName(joined).withColumnRenamed("k", key)
