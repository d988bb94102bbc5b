"""One consistent form for texts that look the same but consist of different characters.

Method: confusables skeleton. Characters that show nothing are dropped, width forms, compatibility letters and spaces
become plain, the rest is decomposed canonically, every character is replaced by its prototype of a look-alike table, and the result is decomposed
again. Texts look the same when their skeletons are equal. Kept as differences: case, accents that are present in one
text only, raised and lowered digits, punctuation, and the number of blanks and line breaks.
"""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewave.llm.graph import HOT_CLASS

# Letters of other scripts and signs, each list beside the prototypes it looks like, in the same order.
# Compatibility letters (ligatures, Roman numerals, styled letters) are not listed: they follow from the character data.
LOOK_ALIKES = {
    # Cyrillic
    "АВЕЅІЈКМНОРСТУХҮԌԚԜ": "ABESIJKMHOPCTYXYGQW",
    "аеѕіјорсухһԁԛԝѵӏɡ": "aesijopcyxhdqwvlg",
    # Greek
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ": "ABEZHIKMNOPTYXCM",
    "αγινορυϲϳ": "ayivopucj",
    # Coptic
    "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬ": "BHIKMNOPCTX",
    "ⲟⲣⲥ": "opc",
    # Armenian
    "ՏՍՕսօոհցք": "SUOuonhgp",
    # Cherokee
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHGZVSLCPKB",
    # Lisu
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    # Latin letters of phonetics, small capitals of the shape of small letters, clicks
    "ɑɩᴄᴏᴠᴡᴢꜱᴜ": "aicovwzsu",
    "ǃǀ": "!|",
    # Signs: hyphens, dots, colons, bars
    "‐‑﹣": "---",
    "․‚": ".,",
    "⁄∕": "//",
    "∶꞉։׃": "::::",
    "∣": "|",
    "∗": "*",
    "∼": "~",
}

#: Blocks of invisible characters that are not of category Cf: joiners, selectors, fillers.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))


@functools.cache
def tables() -> tuple[dict[int, str | None], dict[int, str]]:
    """What to do before and after the decomposition, by rule from the character database and the look-alikes."""
    before: dict[int, str | None] = {}
    listed = set("".join(LOOK_ALIKES))
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" and not 0x600 <= code <= 0x6FF and code not in (0x70F, 0x8E2, 0x110BD, 0x110CD):
            before[code] = None  # the excluded ones are visible number and verse signs
        elif kind == "Zs":
            before[code] = " "
        else:
            form = unicodedata.decomposition(c)
            plain = "".join(chr(int(x, 16)) for x in form.split()[1:]) if form.startswith("<") else ""
            if form.startswith(("<wide>", "<narrow>")) or plain and c not in listed and kind[0] in "LN" and form.startswith(("<compat>", "<font>")) and plain.isalnum():
                before[code] = plain
    before[0x61C] = None
    for low, high in INVISIBLE:
        before |= dict.fromkeys(range(low, high + 1))
    after = {ord(a): b for many, prototypes in LOOK_ALIKES.items() for a, b in zip(many, prototypes, strict=True)}
    return before, after


@functools.cache
def _replacements() -> tuple[dict[str, str], dict[str, str]]:
    return tuple({chr(c): t or "" for c, t in table.items()} for table in tables())


def _replace(text: str, table: dict[str, str]) -> str:
    """`text` with all characters of a table replaced; what it holds is looked up once a character, not once a place."""
    for c in table.keys() & set(text):
        text = text.replace(c, table[c])
    return text


def skeleton(text: str) -> str:
    """The decomposed skeleton of a text."""
    if text.isascii():
        return text
    before, after = _replacements()
    return unicodedata.normalize("NFD", _replace(unicodedata.normalize("NFD", _replace(text, before)), after))


def form(text: str | None) -> str | None:
    """The consistent form of a text: its skeleton, composed again. Null stays null."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text))


def forms(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `form` of every row; null texts have a null form, empty ones an empty form."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(form, part.column(1).to_pylist())), pa.string())], ["k", "form"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, form string").withColumnRenamed("k", key)


def keys(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, digest of the text and digest of its skeleton, for texts with at least one letter or digit."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.blake2b(s.encode(), digest_size=16).digest()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column(1).to_pylist()
                skeletons = list(map(skeleton, texts))
                keep = pa.array([any(map(str.isalnum, s)) for s in skeletons])
                out = [part.column(0), pa.array([digest(t) for t in texts], pa.binary()), pa.array([digest(s) for s in skeletons], pa.binary())]
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in out], ["k", "text_key", "skeleton_key"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text_key binary, skeleton_key binary").withColumnRenamed("k", key)


def _classes(keyed: DataFrame) -> DataFrame:
    """(skeleton_key, text_key, n): classes of equal texts whose skeleton another text has, too."""
    classes = keyed.groupBy("skeleton_key", "text_key").agg(F.count("*").alias("n"))
    varied = classes.groupBy("skeleton_key").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("skeleton_key")
    return classes.join(varied, "skeleton_key", "left_semi")


def same_looking(keyed: DataFrame, *, key: str = "doc_id", hot: int = HOT_CLASS) -> DataFrame:
    """Pairs (`a`, `b`), a < b, of rows of `keys` with different texts and equal skeletons.

    Only skeletons with at least two different texts go on, as classes of equal texts; classes are paired first and then
    expanded, so equal copies are never compared with each other and the work follows the number of result pairs. The
    copies of a text that has more than `hot` of them are spread over parts, which every partner meets.
    `keyed` is read more than once and should be a written table.
    """
    texts = _classes(keyed).withColumn("parts", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    members = keyed.join(texts, ["skeleton_key", "text_key"]).select("text_key", F.col(key).alias("id"), F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = (
        texts.select("skeleton_key", F.col("text_key").alias("text_a"), F.col("parts").alias("parts_a"))
        .join(texts.select("skeleton_key", F.col("text_key").alias("text_b"), F.col("parts").alias("parts_b")), "skeleton_key").where("text_a < text_b")
        .withColumn("part_a", every("parts_a")).withColumn("part_b", every("parts_b")).select("text_a", "part_a", "text_b", "part_b")
    )
    left = members.select(F.col("text_key").alias("text_a"), F.col("part").alias("part_a"), F.col("id").alias("a"))
    right = members.select(F.col("text_key").alias("text_b"), F.col("part").alias("part_b"), F.col("id").alias("b"))
    return pairs.join(left, ["text_a", "part_a"]).join(right, ["text_b", "part_b"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def looks(keyed: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row per row of `keys` whose skeleton another text has, too: `key`, `class_id` (the smallest key of all rows of
    the skeleton) and `links` (its rows with another text). No pairs are made: a class that a third of all rows share
    costs as much as any other."""
    texts = _classes(keyed)
    size = texts.groupBy("skeleton_key").agg(F.sum("n").alias("size"))
    first = keyed.groupBy("skeleton_key").agg(F.min(key).alias("class_id"))
    rows = keyed.join(texts, ["skeleton_key", "text_key"]).join(size, "skeleton_key").join(first, "skeleton_key")
    return rows.select(key, "class_id", (F.col("size") - F.col("n")).alias("links"))
