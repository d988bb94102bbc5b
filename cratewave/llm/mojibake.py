"""Text that was decoded with a wrong character encoding: finding it and restoring the original.

Method: noisy-channel decoding. Every word with characters outside ASCII is turned back into a lattice of bytes under each
encoding it may wrongly have been read with: a character stands for its byte, or for that of its capital where case may
have been folded, and a lost one for any byte (a wildcard). The lattice is read under each encoding the text may really
have been in, and a Viterbi search keeps the readings that are likely under a character model of the corpus; a lattice
with a single path, which most words have, needs no search and is read by the codec. The readings of all words are then
weighed by the frequencies of whole words in the corpus, with the character model for words that the corpus does not
have: a word is damaged if a reading explains it much better than the word itself. Words whose characters are partly lost
beyond that are lattices of whole words: corpus words with the same remaining letters, if some pair of encodings turns the
one into the other.

Counts of words are joined, never broadcast; the character model has a fixed size (hashed counts).
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewave.storage import materialize

LOST = "�"
BLANKS = "[ \\t\\r\\n]+"
# Encodings that text is wrongly read with, and encodings that it is really in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_15", "cp932", "gbk", "big5")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_7", "cp932", "euc_jp", "gbk")
MULTI = ("utf-8", "cp932", "euc_jp", "gbk", "big5")
UNIGRAMS, BIGRAMS = 1 << 14, 1 << 18
BEAM, KEPT = 12, 4


@functools.cache
def byte_table(encoding: str) -> dict[str, int]:
    """Byte of each character of a single-byte encoding; undefined bytes are the control characters of their number."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that an encoding reads as `text`, or None."""
    if encoding in MULTI:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = byte_table(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def from_bytes(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def key_of(word: str) -> str:
    """What a word is counted as: lower case, without ASCII punctuation at its ends."""
    return word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()


class Model:
    """Character bigrams of the corpus, hashed into tables of fixed size."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray) -> None:
        self.uni, self.bi, self.total = uni, bi, max(1.0, float(uni.sum()))
        self.cached = functools.lru_cache(200_000)(self._step)

    def _step(self, a: str, b: str) -> float:
        pu = (self.uni[hash_uni(b)] + 0.05) / (self.total + 0.05 * UNIGRAMS)
        return math.log((self.bi[hash_bi(a, b)] + 4 * pu) / (self.uni[hash_uni(a)] + 4))

    def step(self, a: str, b: str) -> float:
        return self.cached(a, b)

    def word(self, w: str) -> float:
        return sum(self.step(a, b) for a, b in zip("^" + w, w + "$"))

    def without(self, key: str, n: float) -> Model:
        """The model as if a word had been counted `n` times less."""
        uni, bi = self.uni.copy(), self.bi.copy()
        for a, b in zip("^" + key, key + "$"):
            uni[hash_uni(a)] -= n
            bi[hash_bi(a, b)] -= n
        return Model(np.maximum(uni, 0), np.maximum(bi, 0))


def hash_uni(c: str) -> int:
    return zlib.crc32(c.encode("utf-8", "surrogatepass")) % UNIGRAMS


def hash_bi(a: str, b: str) -> int:
    return zlib.crc32((a + "\0" + b).encode("utf-8", "surrogatepass")) % BIGRAMS


def group_of(c: str) -> str:
    """Coarse script of a letter; other characters by their general category."""
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return "M"
    if kind[0] != "L":
        return kind
    name = unicodedata.name(c, "?").split()[0]
    return {"CJK": "J", "HIRAGANA": "J", "KATAKANA": "J", "KATAKANA-HIRAGANA": "J", "HALFWIDTH": "H", "LATIN": "Latn", "GREEK": "Grek", "CYRILLIC": "Cyrl", "FEMININE": "So", "MASCULINE": "So", "MICRO": "So"}.get(name, name)


def oddness(word: str) -> int:
    """How many places of a word look unlike writing: control and private characters, signs beside letters, a change
    of script, and a capital after a small letter outside ASCII."""
    odd = 0
    groups = [group_of(c) for c in word]
    for i, (c, g) in enumerate(zip(word, groups)):
        if c == LOST or g in ("Cc", "Co", "Cn", "Cf"):
            odd += 2
        elif ord(c) > 127 and g in ("So", "Sm", "Sc", "Sk", "Lm", "No", "Po", "Pi", "Pf", "Ps", "Pe", "Pd", "H"):
            near = groups[max(0, i - 1) : i] + groups[i + 1 : i + 2]
            odd += any(x in ("Latn", "Grek", "Cyrl", "J", "So", "Sm", "Sc", "Sk", "Po", "Pi", "Pf") and x == x for x in near)
        if i and g != groups[i - 1] and {g, groups[i - 1]} <= {"Latn", "Grek", "Cyrl", "J", "HANGUL", "ARABIC", "HEBREW"}:
            odd += 1
        if i and ord(c) > 127 and c.isupper() and word[i - 1].islower():
            odd += 1
        if i and ord(word[i - 1]) > 127 and word[i - 1].isupper() and c.islower() and ord(c) > 127 and i > 1 and word[i - 2].islower():
            odd += 1
    return odd


def lattice(word: str, encoding: str) -> list[tuple[int | None, ...]]:
    """Possible bytes of a word that was read with an encoding: of each character its own, that of its capital where case
    may have been folded, any (None) where it was lost. Empty if a character has no bytes."""
    if encoding in MULTI:
        data = [None if c == LOST else to_bytes(c, encoding) for c in word]
        return [] if any(d is None and c != LOST for c, d in zip(word, data)) else [cell for d in data for cell in ([(None,)] if d is None else [(x,) for x in d])]
    table = byte_table(encoding)
    folded = word == word.lower()
    out: list[tuple[int | None, ...]] = []
    for c in word:
        if c == LOST:
            out.append((None,))
            continue
        options = [table[c]] if c in table else []
        if folded and ord(c) > 127 and len(c.upper()) == 1 and c.upper() != c and c.upper() in table:
            options.append(table[c.upper()])
        if not options:
            return []
        out.append(tuple(options))
    return out


Alphabet = dict[str, dict[tuple[int, ...], list[str]]]


def viterbi(word: str, cells: list[tuple[int | None, ...]], right: str, model: Model, alphabet: Alphabet, most: int = 12) -> list[tuple[str, float]]:
    """Best readings of a byte lattice under an encoding and their log likelihoods. Lost and
    missing bytes are filled by characters of `alphabet` (encoding -> bytes with -1 as wildcard -> characters)."""
    n = len(cells)
    known = alphabet.get(right, {})
    step = readings if right == "utf-8" else pairs_of if right in MULTI else singles
    # the best few ways to each last character: a filled gap is told by the frequency of the whole word, not by its ends
    beams: list[dict[str, list[tuple[float, str]]]] = [{} for _ in range(n + 1)]
    beams[0]["^"] = [(0.0, "")]
    for i in range(n):
        best = sorted(beams[i].items(), key=lambda z: -z[1][0][0])[:BEAM]
        if not best:
            continue
        ways = list(step(cells, i, known) if right == "utf-8" else step(cells, i, known, right))
        for last, texts in best:
            for end, chars, cost in ways:
                for c in chars:
                    more = model.step(last.lower()[:1], c.lower()[:1]) - cost
                    kept = beams[end].setdefault(c, [])
                    for score, text in texts:
                        if len(kept) == KEPT and score + more <= kept[-1][0]:
                            break
                        insort(kept, (score + more, text + c), key=lambda z: -z[0])
                        del kept[KEPT:]
    final = [(s + model.step(c.lower()[:1], "$"), t) for c, texts in beams[n].items() for s, t in texts]
    found: dict[str, float] = {}
    for score, text in sorted(final, reverse=True):
        if text != word:
            found.setdefault(text, score)
    return list(found.items())[:most]


@functools.cache
def _character(data: bytes, encoding: str) -> str | None:
    text = from_bytes(data, encoding)
    return text if text is not None and len(text) == 1 else None


def singles(cells: list[tuple[int | None, ...]], i: int, known: dict[tuple[int, ...], list[str]], encoding: str) -> Iterator[tuple[int, list[str], float]]:
    """(next position, characters, cost) of the readings of a lattice by a single-byte encoding."""
    for b in cells[i]:
        if b is None:
            yield i + 1, known.get((-1,), []), 3.0
        elif (c := _character(bytes([b]), encoding)) is not None:
            yield i + 1, [c], 0.0


def pairs_of(cells: list[tuple[int | None, ...]], i: int, known: dict[tuple[int, ...], list[str]], encoding: str) -> Iterator[tuple[int, list[str], float]]:
    """The same by an encoding of one or two bytes a character; either byte of a pair may be lost, or the second missing."""
    for b in cells[i]:
        if b is not None and (c := _character(bytes([b]), encoding)) is not None:
            yield i + 1, [c], 0.0
            continue
        lead = -1 if b is None else b
        for second in cells[i + 1] if i + 1 < len(cells) else ():
            if second is not None and lead >= 0:
                if (c := _character(bytes([lead, second]), encoding)) is not None:
                    yield i + 2, [c], 0.0
            elif (lead, second) != (-1, None):
                yield i + 2, known.get((lead, -1 if second is None else second), []), 1.0
        if lead >= 0:
            yield i + 1, known.get((lead, -1), []), 6.0
        else:
            yield i + 1, known.get((-1,), []), 3.0


def readings(cells: list[tuple[int | None, ...]], i: int, alphabet: dict[tuple[int, ...], list[str]]) -> Iterator[tuple[int, list[str], float]]:
    """(next position, characters, cost) of the readings of a lattice from a position on."""
    for lead in cells[i]:
        if lead is None:
            yield i + 1, alphabet.get((-1,), []), 3.0
            rest: tuple[int, ...] = (-1,)
            for cell in cells[i + 1 : i + 4]:  # a lead that was lost before bytes that follow one
                if cell[0] is None or not 0x80 <= cell[0] < 0xC0:
                    break
                rest = (*rest, cell[0])
                yield i + len(rest), alphabet.get(rest, []), 1.0
            continue
        if lead < 0x80:
            yield i + 1, [chr(lead)], 0.0
            continue
        need = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        if not need:
            continue
        # each following byte is the next cell's, lost there, or missing altogether
        stack: list[tuple[int, tuple[int, ...], float]] = [(i + 1, (lead,), 0.0)]
        while stack:
            at, got, cost = stack.pop()
            if len(got) == need + 1:
                if -1 in got:
                    yield at, alphabet.get(got, []), cost
                else:
                    try:
                        yield at, [bytes(got).decode()], cost
                    except UnicodeDecodeError:
                        pass
                continue
            if at < len(cells):
                for b in cells[at]:
                    if b is None:
                        stack.append((at + 1, (*got, -1), cost + 1.0))
                    elif 0x80 <= b < 0xC0:
                        stack.append((at + 1, (*got, b), cost))
            if got.count(-1) == 0:
                stack.append((at, (*got, -1), cost + 6.0))
            if at == len(cells) and len(got) == need:
                stack.append((at, (*got, 0xA0), cost + 1.0))  # a no-break space that became the blank after the word


def patterns(characters: list[str]) -> Alphabet:
    """Per encoding: bytes of characters, each with all but one of them, or all, as wildcards (-1) -> the characters."""
    out: Alphabet = {}
    for encoding in WRITTEN_IN:
        own = out.setdefault(encoding, {(-1,): []})
        for c in characters:
            data = to_bytes(c, encoding) if encoding in MULTI else bytes([t]) if (t := byte_table(encoding).get(c)) is not None and _character(bytes([t]), encoding) == c else None
            if not data:
                continue
            own[(-1,)].append(c)
            if encoding == "utf-8":
                if len(data) > 1:
                    own.setdefault((-1, *data[1:]), []).append(c)
                for mask in range(1, 1 << (len(data) - 1)):
                    own.setdefault((data[0], *(-1 if mask >> k & 1 else data[k + 1] for k in range(len(data) - 1))), []).append(c)
            elif len(data) == 2:
                own.setdefault((data[0], -1), []).append(c)
                own.setdefault((-1, data[1]), []).append(c)
    return out


def single_paths(word: str) -> Iterator[tuple[str, str]]:
    """(reading, kind) of the lattices of a word in which every character stands for its own byte, so that each pair of
    encodings has a single path, without a search; and again where the first reading was UTF-8."""
    seen = {word}
    for wrong in READ_AS:
        data = to_bytes(word, wrong)
        if data is None:
            continue
        for right in WRITTEN_IN:
            if right == wrong or (right in MULTI and wrong in MULTI and right != "utf-8"):
                continue
            text = from_bytes(data, right)
            if text is None or text in seen or "\0" in text:
                continue
            seen.add(text)
            yield text, "utf-8" if right == "utf-8" else right
            if right == "utf-8":
                for wrong2 in READ_AS:
                    again = to_bytes(text, wrong2)
                    twice = None if again is None else from_bytes(again, "utf-8")
                    if twice is not None and twice not in seen:
                        seen.add(twice)
                        yield twice, "utf-8"


def mask_of(word: str) -> str | None:
    """A word with each run of characters outside ASCII as one star; None unless three ASCII letters remain."""
    out, letters = [], 0
    for c in word:
        if ord(c) > 127:
            if not out or out[-1] != "*":
                out.append("*")
        else:
            out.append(c)
            letters += c.isalpha()
    return "".join(out) if letters >= 3 else None


@functools.cache
def _confusions() -> dict[str, frozenset[str]]:
    """Character -> what its bytes in some encoding are read as, whole, in some other."""
    out: dict[str, set[str]] = {}
    letters = [chr(c) for c in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)) if chr(c).isalpha()]
    for right in WRITTEN_IN:
        for c in letters:
            data = to_bytes(c, right)
            if data is None:
                continue
            for wrong in READ_AS:
                if wrong == right or wrong in MULTI:
                    continue
                text = data.decode(wrong, "replace") if not any(0x80 <= b < 0xA0 for b in data) else "".join(from_bytes(bytes([b]), wrong) or chr(b) for b in data)
                if text != c:
                    out.setdefault(c, set()).update((text, text.lower()))
    return {c: frozenset(t) for c, t in out.items()}


def explains(true: str, seen: str) -> bool:
    """Whether a run of `true` characters may have become the run `seen`: lost, or read wrongly with some part dropped."""
    if LOST in seen:
        return len(seen) <= 3 * len(true) + 1
    if len(true) > 3:
        return False
    table = _confusions()
    options = [""]
    for c in true:
        texts = table.get(c, frozenset())
        # a dropped character leaves a part of the sequence
        parts = {t for x in texts for t in ([x] if len(x) < 2 else [x, *(x[:k] + x[k + 1 :] for k in range(len(x)))])}
        options = [o + p for o in options for p in parts if seen.startswith(o + p)]
    return seen in options


def runs(word: str) -> list[str]:
    out: list[str] = []
    inside = False
    for c in word:
        if ord(c) > 127:
            if inside:
                out[-1] += c
            else:
                out.append(c)
            inside = True
        else:
            inside = False
    return out


def fill(word: str, reading: str) -> str:
    """The word with its runs outside ASCII replaced by those of a reading, as capitals if its letters are."""
    parts = iter(runs(reading))
    plain = "".join(c for c in word if c.isascii() and c.isalpha())
    out: list[str] = []
    inside = False
    for c in word:
        if c.isascii():
            out.append(c)
        elif not inside:
            part = next(parts, "")
            first = not any(x.isalpha() for x in out)
            out.append(part.upper() if plain.isupper() and len(plain) > 1 else part.capitalize() if first and plain[:1].islower() and word[:1] != word[:1].lower() else part)
        inside = not c.isascii()
    return "".join(out)


#: Characters of ordinary writing outside ASCII, as ranges.
ORDINARY = ((0xA0, 0x17F), (0x218, 0x21B), (0x370, 0x3FF), (0x400, 0x491), (0x5D0, 0x5EA), (0x620, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2010, 0x2044), (0x20AC, 0x20AC), (0x2122, 0x2122), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def sure(word: str, text: str) -> bool:
    """Whether a reading holds whatever the counts: all bytes of the word, read with single-byte encodings, are UTF-8 of
    ordinary characters, and its oddness goes away. One odd place alone may be a quotation mark or a dash after a
    capital, so there it must be another sign."""
    odd = oddness(word)
    if not odd or oddness(text) or not all(ord(c) < 128 or any(a <= ord(c) <= b for a, b in ORDINARY) for c in text):
        return False
    if odd == 1 and not any(ord(c) > 127 and group_of(c) in ("So", "Sm", "Sc", "Sk", "No") for c in word):
        return False
    at = {word}
    for _ in range(2):
        data = [to_bytes(w, wrong) for w in at for wrong in READ_AS if wrong not in MULTI]
        at = {t for t in (from_bytes(b, "utf-8") for b in data if b is not None) if t is not None} - {word}
        if text in at:
            return True
    return False


def readings_of(word: str, model: Model, alphabet: Alphabet, damped: Model | None = None, count: float = 1.0) -> list[tuple[str, str, float, int, bool]]:
    """(reading, kind, gain, oddness removed, sure) of a word. Gains are log likelihoods over the word's own; for a
    reading that removes oddness also under `damped`, which has the word `count` times and, beside a UTF-8 reading,
    takes it once."""
    own, odd = model.word(word.lower()), oddness(word)
    found: dict[str, tuple[str, float, int, bool]] = {}
    once = None
    for text, kind in single_paths(word):
        if any(unicodedata.category(c) in ("Cc", "Co", "Cn") for c in text):
            continue
        gain, less = model.word(text.lower()) - own, odd - oddness(text)
        certain = False
        if kind == "utf-8" and less > 0:
            certain = sure(word, text)
        if less > 0 and damped:
            if kind == "utf-8" and count > 1:
                once = once or damped.without(key_of(word), count - 1)
            other = once if kind == "utf-8" and once else damped
            gain = max(gain, other.word(text.lower()) - other.word(word.lower()))
        if gain > 0 or certain or kind == "utf-8" and gain > -6:
            found[text] = (kind, gain, less, certain)
    # lattices with more than one path: lost characters under all encodings, folded and missing ones under UTF-8
    strict = any(k == "utf-8" for k, *_ in found.values())
    lost = LOST in word
    seen: set[tuple] = set()
    for wrong in READ_AS if lost or not strict and (odd or word == word.lower()) else ():
        cells = lattice(word, wrong)
        if not cells:
            continue
        for right in WRITTEN_IN if lost else ("utf-8",):
            if right == wrong or (right, *cells) in seen or right == "utf-8" and strict:
                continue
            seen.add((right, *cells))
            for text, score in viterbi(word, cells, right, model, alphabet):
                if text not in found and score - own > -4 and not any(unicodedata.category(c) in ("Cc", "Co", "Cn") for c in text):
                    found[text] = ("utf-8 lattice" if right == "utf-8" else "lattice", score - own, odd - oddness(text), False)
    return [(t, *x) for t, x in found.items()]


#: Score above which a reading is taken; see `damaged`.
LIMIT = 1.0
#: What a corpus word with the same remaining letters must score more where it is as odd as the word.
MASK_COST = 1.0
#: Words of one mask up to which they are compared in one piece.
HOT_MASK = 1_000


def fields_of(tables: list[tuple[DataFrame, str, str]], columns: list[str]) -> DataFrame:
    """(table_name, row_id, field_name, value) of the values with characters outside ASCII of (table, name, key) tables."""
    out = None
    for df, name, key in tables:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns]))
        part = df.select(F.col(key).cast("bigint").alias("row_id"), pairs.alias("p")).select(F.lit(name).alias("table_name"), "row_id", F.col("p.f").alias("field_name"), F.col("p.v").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("value").rlike(r"[^\x00-\x7F]"))


def model_of(words: DataFrame, by: str = "n") -> tuple[Model, Alphabet]:
    """Character model and alphabet of words (key, and a count `by`), over all of them. Tables of fixed size reach the
    driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[tuple[str, int], float] = {}
            for w, n in zip(b.column("key").to_pylist(), b.column(by).to_pylist()):
                for a, c in zip("^" + w, w + "$"):
                    for k in (("u", hash_uni(a)), ("b", hash_bi(a, c)), ("c", ord(a))):
                        got[k] = got.get(k, 0) + n
            kinds, slots = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(slots, pa.int64()), pa.array(list(got.values()), pa.float64())], ["kind", "slot", "n"])

    uni, bi, characters = np.zeros(UNIGRAMS), np.zeros(BIGRAMS), []
    counted = words.mapInArrow(count, "kind string, slot bigint, n double").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    for kind, slot, n in zip(*(counted.column(c).to_pylist() for c in ("kind", "slot", "n"))):
        if kind == "u":
            uni[slot] = n
        elif kind == "b":
            bi[slot] = n
        elif slot > 127 and chr(slot).isalpha():
            characters.append((-n, chr(slot)))
    return Model(uni, bi), patterns([c for _, c in sorted(characters)])


def damaged(fields: DataFrame, *, limit: float = LIMIT, positions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(damaged words: token, reading or null) and (all their places: table_name, row_id, field_name, token, and with
    `positions` the number `pos` of the word in the value).

    `fields` comes from `fields_of`. A word is damaged if it has replacement, control or private characters, or if one
    of its readings scores more than `limit`: gain in log likelihood under the character model, twice the oddness that
    goes away, twice the log ratio of the words' counts, and 3 for readings as UTF-8, which rarely hold by chance, 6 if
    oddness goes away, too (3 if bytes are lost or missing). A reading that is neither UTF-8 nor less odd must be a word of the corpus.

    Repeats of a damaged value are no evidence for it: for a reading that removes oddness, the gain and the ratio are
    also taken with the repeats of a value counted by their logarithm, and the better ones hold. A word never counts against a
    UTF-8 reading that removes oddness as more than a single row, and some such readings hold by themselves (`sure`).
    Null, empty and plain ASCII values are not damaged. All counts are taken over all words of all fields.
    """
    spark = fields.sparkSession
    split = F.split("value", BLANKS)
    word = [F.posexplode(split).alias("pos", "token")] if positions else [F.explode(split).alias("token")]
    places = materialize(fields.select("table_name", "row_id", "field_name", *word).where(F.col("token").rlike(r"[^\x00-\x7F]")), "places")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [key_of(t) for t in b.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], ["token", "n", "d", "key"])

    values = fields.groupBy("value").agg(F.count("*").alias("n")).select("n", F.explode(split).alias("token")).where(F.col("token").rlike(r"[^\x00-\x7F]"))
    words = values.groupBy("token").agg(F.sum("n").alias("n"), F.sum(1 + F.log("n")).alias("d"))
    words = materialize(words.mapInArrow(keyed, "token string, n bigint, d double, key string"), "words")
    counts = words.groupBy("key").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = materialize(counts, "counts")
    shared = spark.sparkContext.broadcast((*model_tables(model_of(counts)), *model_tables(model_of(counts, "d"))[:2]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi, alphabet, *others = shared.value
        model, damped = Model(uni, bi), Model(*others)
        for b in batches:
            rows: list[tuple] = []
            for token, key, d in zip(*(b.column(c).to_pylist() for c in ("token", "key", "own_d"))):
                bare = not any(c.isalnum() for c in token)  # nothing but counts tells what it was
                lost = any(c == LOST or unicodedata.category(c) in ("Cc", "Co", "Cn") for c in token)
                if lost:
                    rows.append((token, key, None, None, 0.0, False, False, False, None))
                for text, kind, gain, odd, certain in readings_of(token, model, alphabet, damped, d):
                    bonus = (6.0 if odd > 0 else 3.0) if kind == "utf-8" else 3.0 if kind == "utf-8 lattice" and odd > 0 else 0.0
                    # the least that the counts may add: what they add for a single row beside an unknown reading
                    floor = 2 * math.log(0.3 / 1.3) if kind == "utf-8" and odd > 0 else None
                    rows.append((token, key, text, key_of(text), gain + 2.0 * odd + bonus, odd <= 0 or bare, kind != "utf-8" and odd <= 0, certain, floor))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64()))],
                ["token", "key", "reading", "reading_key", "gain", "as_odd", "known_only", "sure", "floor"],
            )

    found = words.join(counts.select("key", F.col("d").alias("own_d")), "key").repartition(4 * spark.sparkContext.defaultParallelism, "token").mapInArrow(
        read, "token string, key string, reading string, reading_key string, gain double, as_odd boolean, known_only boolean, sure boolean, floor double"
    )

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), b.column("d"), pa.array([mask_of(k) for k in keys], pa.string())], ["key", "n", "d", "mask"])

    masks = counts.mapInArrow(masked, "key string, n bigint, d double, mask string").where("mask is not null")
    # a mask of many words is cut into parts, which all words of the mask meet in tasks of their own
    parts = masks.groupBy("mask").agg(F.ceil(F.count("*") / HOT_MASK).cast("int").alias("parts")).where("parts > 1")
    cut = masks.join(parts, "mask", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    alike = (
        cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        .join(cut.select("mask", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("reading"), F.col("n").alias("m"), F.col("d").alias("e")), ["mask", "part"])
        .where("key <> reading").select("key", "reading", "n", "m", "d", "e")
    )

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("key").to_pylist(), b.column("reading").to_pylist()
            odd = [oddness(k) - oddness(r) for k, r in zip(keys, texts)]
            keep = [o >= 0 and LOST not in r and all(x == y or explains(x, y) for x, y in zip(runs(r), runs(k))) for k, r, o in zip(keys, texts, odd)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odd, pa.int64()), pa.array([LOST in k for k in keys], pa.bool_())], [*b.schema.names, "odd", "lost"]).filter(pa.array(keep, pa.bool_()))

    # only counts tell two words that are equally odd apart; a word that has lost characters is damaged in any case
    rows = 2 * F.log(F.col("m") / F.col("n"))
    ratio = F.when(F.col("odd") > 0, F.greatest(rows, 2 * F.log(F.col("e") / F.col("d"))) + 2 * F.col("odd")).otherwise(rows - MASK_COST)
    by_mask = alike.mapInArrow(explained, "key string, reading string, n bigint, m bigint, d double, e double, odd bigint, lost boolean").select("key", "reading", ratio.alias("score"), F.col("lost").alias("sure"))
    def cased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            readings = [fill(t, r) for t, r in zip(b.column("token").to_pylist(), b.column("reading").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(readings, pa.string()), b.column("score"), b.column("sure")], ["token", "reading", "score", "sure"])

    def log_ratio(its: str, own: str) -> Column:
        return 2 * F.log((F.coalesce(its, F.lit(0)) + 0.3) / (F.col(own) + 0.3))

    by_count = F.when(F.col("as_odd"), log_ratio("its", "own")).otherwise(F.greatest(log_ratio("its", "own"), log_ratio("its_d", "own_d"), "floor"))
    scored = (
        found.join(counts.select("key", F.col("n").alias("own"), F.col("d").alias("own_d")), "key")
        .join(counts.select(F.col("key").alias("reading_key"), F.col("n").alias("its"), F.col("d").alias("its_d")), "reading_key", "left")
        .where("not known_only or its is not null")
        .select("token", "reading", F.when(F.col("reading").isNull(), F.lit(float(limit)) + 1e-6).otherwise(F.col("gain") + by_count).alias("score"), "sure")
        .unionByName(words.select("token", "key").join(by_mask, "key").select("token", "reading", "score", "sure").mapInArrow(cased, "token string, reading string, score double, sure boolean"))
        .where((F.col("score") > limit) | F.col("sure"))
    )
    best = Window.partitionBy("token").orderBy(F.col("reading").isNull(), F.desc("score"), "reading")
    bad = materialize(scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("token", "reading"), "damaged")
    return bad, places.join(bad.select("token"), "token", "left_semi")


def model_tables(both: tuple[Model, Alphabet]) -> tuple[np.ndarray, np.ndarray, Alphabet]:
    """What a model is shipped as: its count tables and the alphabet."""
    return both[0].uni, both[0].bi, both[1]


def restore(fields: DataFrame, *, limit: float = LIMIT) -> DataFrame:
    """(table_name, row_id, field_name, value, restored, unread) of the damaged values. Damaged words are replaced at
    their places; `unread` counts those without a reading, which stay as they are. Blanks are kept."""
    bad, places = damaged(fields, limit=limit, positions=True)
    at = ["table_name", "row_id", "field_name"]
    swaps = places.join(bad, "token").groupBy(*at).agg(F.collect_list(F.struct("pos", "reading")).alias("swaps"))

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, unread = [], []
            for value, found in zip(b.column("value").to_pylist(), b.column("swaps").to_pylist()):
                parts = re.split(f"({BLANKS})", value)  # words at even places
                for x in found:
                    if x["reading"] is not None:
                        parts[2 * x["pos"]] = x["reading"]
                texts.append("".join(parts))
                unread.append(sum(x["reading"] is None for x in found))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*at, "value")), pa.array(texts, pa.string()), pa.array(unread, pa.int32())], [*at, "value", "restored", "unread"])

    return fields.join(swaps, at).select(*at, "value", "swaps").mapInArrow(swap, "table_name string, row_id bigint, field_name string, value string, restored string, unread int")
