"""Reading and writing catalogs, vectors, lists and settings."""

from __future__ import annotations

import json
import os
import shlex
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewave.functions import text as T

# Fixed value: suffixes of audio files that a scan finds.
AUDIO = ("wav", "flac", "mp3", "m4a", "aiff", "aif")
#: A catalog row; fields appear as stages have run, so all but the path may be null.
TRACK_SCHEMA = (
    "ord bigint, path string, artist string, title string, bpm double, camelot string, key_name string, rating int, added string, duration int, bitrate int, "
    "genre string, subgenre string, grouping string, comments string, tags array<string>, mytags array<string>, samples double"
)


def scan_audio(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the audio files below a folder or of one file, by suffix whatever its case, sorted.
    Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.where(T.suffix(F.col("path")).isin(*AUDIO)).orderBy("path")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a JSON document {"tracks": {path: fields}}; rows are numbered in the order of the paths' appearance. A file
    that is missing or cannot be parsed gives an empty catalog; a broken one is copied beside itself first, under its
    name with `.corrupt_` and the time, so that writing the catalog again loses nothing.

    One document is one value in one task: the exchange format of a personal library. Catalogs of any size are tables,
    see `write_version`."""
    inner = ", ".join(c for c in TRACK_SCHEMA.split(", ") if not c.startswith(("ord ", "path ")))
    empty = spark.createDataFrame([], TRACK_SCHEMA)
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path:
        return empty
    text = spark.read.text(path, wholetext=True)
    broken = text.where(F.try_parse_json("value").isNull() & (F.length("value") > 0)).limit(1).count()
    if broken:
        source = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = source.getFileSystem(spark._jsc.hadoopConfiguration())
        copy = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.corrupt_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, files, copy, False, spark._jsc.hadoopConfiguration())
        return empty
    doc = F.from_json("value", f"tracks map<string, struct<{', '.join(c.replace(' ', ': ', 1) for c in inner.split(', '))}>>")
    rows = text.select(F.posexplode(doc["tracks"]).alias("ord", "path", "t")).select(F.col("ord").cast("bigint").alias("ord"), "path", "t.*")
    return rows.select(*[c.split()[0] for c in TRACK_SCHEMA.split(", ")])


def write_version(df: DataFrame, folder: str) -> str:
    """Write a table as a new version below a folder and point CURRENT to it, so that readers of the old one, including
    the plan of `df`, are not disturbed. Returns the version's path."""
    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    df.sparkSession.createDataFrame([(version,)], "path string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/CURRENT")
    return version


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a table written by `write_version`."""
    return spark.read.parquet(spark.read.text(f"{folder.rstrip('/')}/CURRENT").first()["value"])


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV file with a header as (row_id, wanted columns); `columns` maps wanted names to those of the file. Missing
    columns are null. Row numbers follow the file's order."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    have = {c.lower(): c for c in rows.columns}
    pick = [(F.col(f"`{have[src.lower()]}`") if src.lower() in have else F.lit(None).cast("string")).alias(name) for name, src in columns.items()]
    return rows.select(F.monotonically_increasing_id().alias("row_id"), *pick)


def write_csv(df: DataFrame, folder: str) -> None:
    """A table as CSV files with headers. Blanks around values are kept."""
    df.write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("escape", chr(34)).csv(folder)


def read_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(path, embedding) of the .npy files below a folder: one flat float array each. Files that cannot be read as such
    are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")

    def load(batches):
        import io

        import numpy as np

        for b in batches:
            paths, arrays = [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                if a.ndim == 1 and a.dtype.kind == "f":
                    paths.append(path)
                    arrays.append(a.astype("float32").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(arrays, pa.list_(pa.float32()))], ["path", "embedding"])

    return files.mapInArrow(load, "path string, embedding array<float>")


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, signature, quick) of files: SHA-1 of the content, and time and length as a cheap stand-in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha1("content").alias("signature"), F.concat_ws("_", F.unix_seconds("modificationTime").cast("string"), F.col("length").cast("string")).alias("quick"))


def stem_cache(paths: DataFrame) -> DataFrame:
    """(name, model, stems, n) of cached stems from their paths (path: .../name_model/stem.wav)."""
    parts = F.split("path", "/")
    rows = paths.select(F.element_at(parts, -2).alias("folder"), T.stem(F.col("path")).alias("stem")).where("folder is not null")
    found = rows.groupBy("folder").agg(F.array_sort(F.collect_set("stem")).alias("stems"), F.countDistinct("stem").alias("n"))
    model = F.when(F.contains("folder", F.lit("_")), F.substring_index("folder", "_", -1)).otherwise("")
    name = F.when(F.contains("folder", F.lit("_")), F.regexp_replace("folder", "_[^_]*$", "")).otherwise(F.col("folder"))
    return found.select(name.alias("name"), model.alias("model"), "stems", "n")


def staged_tags(staging: DataFrame) -> DataFrame:
    """(path, tags) of a staging table (path, tag) exported from a player's database: slashes made one kind, tags sorted
    and distinct."""
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "/+", "/")
    return staging.where("path is not null and trim(tag) <> ''").groupBy(path.alias("path")).agg(F.array_sort(F.collect_set(F.trim("tag"))).alias("tags"))


def playlist_json(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, artist, title) of an exported online playlist: {"items": [{"track": {"name", "artists": [{"name"}]}}]}."""
    schema = "items array<struct<track: struct<name: string, artists: array<struct<name: string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("items").alias("row_id", "i"))
    return rows.where("i.track is not null").select("row_id", F.array_join(F.transform("i.track.artists", lambda a: a["name"]), ", ").alias("artist"), F.col("i.track.name").alias("title"))


def read_settings(path: str, default: dict) -> dict:
    """A settings file (JSON, or YAML where a parser is there); missing or broken files give the default."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yml", ".yaml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
    except (OSError, ValueError, ImportError):
        return dict(default)
    except Exception as error:
        if type(error).__module__.startswith("yaml"):
            return dict(default)
        raise
    return found if isinstance(found, dict) else dict(default)


def write_settings(path: str, settings: dict) -> None:
    """Settings as JSON, written beside and moved into place."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(f"{path}.new", path)


def sampling_profile(settings: dict, name: str) -> dict:
    """One profile of sampling settings; an unknown name raises ValueError."""
    if name not in settings:
        raise ValueError(f"unknown sampling profile {name!r}")
    return dict(settings[name])


def parse_folders(text: str) -> list[str]:
    """Folders of a typed list: separated by line ends, semicolons or blanks, with plain or curly quotes around names that
    hold blanks; repeated ones once."""
    for curly, plain in (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'")):
        text = text.replace(curly, plain)
    out: list[str] = []
    for part in text.replace(";", "\n").splitlines():
        part = part.strip()
        if not part:
            continue
        try:
            found = shlex.split(part.replace("\\", "\\\\")) if any(q in part for q in "\"'") else [part]
        except ValueError:
            found = [part.strip("\"'")]
        out += [f for f in found if f not in out]
    return out


# Rates in kbit/s of MPEG audio frames by the index in their header (version 1 or 2, layer), and sample rates.
MPEG_KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def header(content: bytes) -> tuple[int, int]:
    """(sample rate, bits a second) from the header of a WAV, AIFF, FLAC, MP3 or MP4 file; 0 for what it does not tell."""
    at = content[:4]
    if at == b"RIFF" and content[8:12] == b"WAVE":
        i = content.find(b"fmt ", 12)
        rate, per_second = struct.unpack("<II", content[i + 12 : i + 20])
        return rate, 8 * per_second
    if at == b"FORM" and content[8:12] in (b"AIFF", b"AIFC"):
        i = content.find(b"COMM", 12)
        channels, _, bits, exponent, mantissa = struct.unpack(">hIhHQ", content[i + 8 : i + 26])
        rate = int(mantissa * 2.0 ** (exponent - 16446))
        return rate, rate * channels * bits
    if at == b"fLaC":
        packed = int.from_bytes(content[18:26], "big")  # 20 bits rate, 3 channels, 5 width, 36 samples
        rate, samples = packed >> 44, packed & (1 << 36) - 1
        return rate, 8 * len(content) * rate // samples if samples else 0
    if content[4:8] == b"ftyp":
        i, j = content.find(b"mdhd"), content.find(b"mp4a")
        long = content[i + 4] == 1
        scale, length = struct.unpack(">IQ", content[i + 24 : i + 36]) if long else struct.unpack(">II", content[i + 16 : i + 24])
        rate = struct.unpack(">I", content[j + 28 : j + 32])[0] >> 16 if j > 0 else scale
        return rate, 8 * len(content) * scale // length if length else 0
    start = 10 + sum((b & 127) << s for b, s in zip(content[6:10], (21, 14, 7, 0))) if content[:3] == b"ID3" else 0
    while (start := content.find(b"\xff", start)) >= 0 and start + 4 <= len(content):
        word = int.from_bytes(content[start : start + 4], "big")
        version, layer, kbit, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
        if word >> 21 == 0x7FF and version != 1 and layer != 4 and 0 < kbit < 15 and rate != 3:
            return MPEG_RATES[version][rate], 1000 * MPEG_KBITS[1 if version == 3 else 2, layer][kbit - 1]
        start += 1
    return 0, 0


def media_headers(files: DataFrame) -> DataFrame:
    """(path, sample_rate, bitrate) from the headers of binary files (path, content); 0 where a header cannot be read. Of
    MP3 it is the rate of the first frame, of FLAC and MP4 the mean over the file."""

    def read(batches):
        for b in batches:
            found = []
            for content in b.column("content").to_pylist():
                try:
                    found.append(header(content or b""))
                except (struct.error, IndexError, OverflowError):
                    found.append((0, 0))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([r for r, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], ["path", "sample_rate", "bitrate"])

    return files.select("path", "content").mapInArrow(read, "path string, sample_rate int, bitrate int")


def clear_cache(folder: str, names: list[str] | None = None) -> int:
    """Delete the folders of cached stems below a local folder, all or those of some names; returns how many."""
    import shutil

    if not os.path.isdir(folder):
        return 0
    gone = [e.path for e in os.scandir(folder) if e.is_dir() and (names is None or e.name.rpartition("_")[0] in names or e.name in names)]
    for path in gone:
        shutil.rmtree(path)
    return len(gone)


def stage_counts(results: DataFrame, stage: str = "stage", status: str = "status") -> DataFrame:
    """(stage, success, errors, skipped) of the rows that stages of a pipeline have left."""
    n = lambda s: F.count_if(F.col(status) == s)
    return results.groupBy(F.col(stage).alias("stage")).agg(n("success").alias("success"), n("error").alias("errors"), n("skipped").alias("skipped"))
