"""Round trips through files, and streams."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from cratewave.sources import catalog as C
from cratewave.sources import rekordbox, signal
from cratewave.streaming import logs


def test_catalog_json(spark, tmp_path):
    doc = {"tracks": {"/b.mp3": {"artist": "B", "bpm": 120.5, "mytags": ["x"]}, "/a.mp3": {"title": "A"}}}
    path = tmp_path / "meta.json"
    path.write_text(json.dumps(doc))
    rows = C.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [(r.path, r.artist, r.bpm, r.mytags) for r in rows] == [("/b.mp3", "B", 120.5, ["x"]), ("/a.mp3", None, None, None)]
    path.write_text("{broken")
    assert C.read_catalog(spark, str(path)).count() == 0 and [p.read_text() for p in tmp_path.glob("meta.json.corrupt_*")] == ["{broken"]
    assert C.read_catalog(spark, str(tmp_path / "none.json")).count() == 0


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    C.write_version(spark.range(3), folder)
    C.write_version(C.read_version(spark, folder).where("id > 0"), folder)
    assert sorted(r.id for r in C.read_version(spark, folder).collect()) == [1, 2]


def test_csv_and_scan(spark, tmp_path):
    C.write_csv(spark.createDataFrame([("a,b", 'q"x')], "Artist string, t string").coalesce(1), str(tmp_path / "csv"))
    r = C.read_csv(spark, str(tmp_path / "csv"), {"artist": "artist", "title": "T", "none": "none"}).first()
    assert (r.artist, r.title, r.none) == ("a,b", 'q"x', None)
    for n in ("b.WAV", "a.mp3", "c.txt"):
        (tmp_path / "lib" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / "deep" / n).write_bytes(n.encode())
    assert [p.path.rsplit("/", 1)[1] for p in C.scan_audio(spark, str(tmp_path / "lib")).collect()] == ["a.mp3", "b.WAV"]
    assert C.signatures(spark, str(tmp_path / "lib")).where("length(signature) = 40").count() == 3


def test_npy(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.arange(4, dtype=np.float16))
    np.save(tmp_path / "flat.npy", np.zeros((2, 2)))
    (tmp_path / "bad.npy").write_bytes(b"x")
    assert [r.embedding for r in C.read_npy(spark, str(tmp_path)).collect()] == [[0, 1, 2, 3]]


def test_collection_round_trip(spark, tmp_path):
    rows = [(5, "/m/ä & b+c.mp3", 'Q"x', "<T>", 128.125, "8A", "House", ["Peak", "a&b", "Peak"]), (9, "/m/2.mp3", None, None, None, None, None, []), (7, "/m/3.mp3", "A", "B", 99.5, None, None, None)]
    t = spark.createDataFrame(rows, "ord bigint, path string, artist string, title string, bpm double, camelot string, genre string, mytags array<string>")
    path = str(tmp_path / "out.xml")
    assert rekordbox.write_collection(t, path, "Set & more") == 3
    import xml.etree.ElementTree as ET

    root = ET.parse(path).getroot()
    found = root.findall("./COLLECTION/TRACK")
    assert [x.get("TrackID") for x in found] == ["1", "2", "3"] and found[0].get("AverageBpm") == "128.12" and found[0].get("Artist") == 'Q"x' and found[1].get("Location") == "file://localhost/m/3.mp3"
    assert [x.get("Name") for x in root.findall("./COLLECTION/MY_TAGS/TAG")] == ["Peak", "a&b"] and len(root.findall(".//NODE/TRACK")) == 3
    got = {r.path: r.tags for r in rekordbox.read_tags(spark, path).collect()}
    assert got == {"/m/ä & b+c.mp3": ["Peak", "a&b"]}
    assert rekordbox.read_tags(spark, path, t.where("ord = 9").select("path")).count() == 0


def test_settings(tmp_path):
    p = str(tmp_path / "s.json")
    assert C.read_settings(p, {"a": 1}) == {"a": 1}
    C.write_settings(p, {"b": 2})
    assert C.read_settings(p, {}) == {"b": 2}
    assert C.parse_folders('/a b;"/c d" \'/e\'\n“/f”\n\n/a b') == ["/a b", "/c d", "/e", "/f"]


def test_staged_tags_and_stems(spark):
    s = spark.createDataFrame([("C:\\x\\a.mp3", " P "), ("C:/x//a.mp3", "P"), ("b", None), (None, "P")], "path string, tag string")
    assert [(r.path, r.tags) for r in C.staged_tags(s).collect()] == [("C:/x/a.mp3", ["P"])]
    p = spark.createDataFrame([("/c/song_one_demucs/vocals.wav",), ("/c/song_one_demucs/bass.wav",)], "path string")
    assert tuple(C.stem_cache(p).first()) == ("song_one", "demucs", ["bass", "vocals"], 2)


def test_log_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(i, t + dt.timedelta(hours=i), t, "/x", "accepted" if i % 3 else "rejected", " Peak ", 0.5, None, None) for i in range(30)]
    df = spark.createDataFrame([*rows, rows[0]], logs.LOG_SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "log"))
    q = logs.usage_counts(logs.read_log(spark, str(tmp_path / "log"), 1)).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("usage").first()) == ("Peak", 20, 11)
    q = logs.action_counts(logs.read_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").count() == 0  # the windows stay open for late rows


def test_index_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"/{i % 8}") for i in range(20)], "ord bigint, path string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord bigint, path string").parquet(str(tmp_path / "in"))
    logs.keep_index(stream, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.path: r.label for r in C.read_version(spark, str(tmp_path / "index")).collect()}
    assert got == {f"/{i}": i for i in range(8)}


def test_signal_features(spark):
    rate = 22050
    t = np.arange(rate * 4) / rate
    clicks = np.zeros_like(t)
    clicks[:: rate // 2] = 1.0  # 120 beats a minute
    y = (0.2 * np.sin(2 * np.pi * 440 * t) + clicks).astype(np.float32)
    df = spark.createDataFrame([("/a", y.tolist(), rate), ("/empty", [], rate), ("/silent", [0.0] * 5000, rate)], "path string, samples array<float>, rate int")
    got = {r.path: r for r in signal.features(df).collect()}
    assert set(got) == {"/a", "/silent"} and abs(got["/a"].bpm - 120) < 3 and int(np.argmax(got["/a"].chroma)) == 9 and len(got["/a"].rhythm) == 256 and got["/silent"].bpm == 0
    assert signal.pick_tails(np.array([0, 5, 0, 4, 0, 6, 0.0]), np.arange(7.0), 2, 3.0) == [5.0, 1.0]


def wav(path, rate=96_000, n=100):
    import wave

    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(b"\0\1" * n)


def test_headers_and_decoding(spark, tmp_path):
    wav(tmp_path / "a.wav")
    (tmp_path / "b.wav").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted((r.path[-5:], r.sample_rate, r.bitrate) for r in C.media_headers(files).collect()) == [("a.wav", 96_000, 1_536_000), ("b.wav", 0, 0)]
    assert sorted((len(r.samples or []), r.rate) for r in signal.decode(files).where("samples is not null").collect()) == [(100, 96_000)]


def test_headers():
    import struct

    flac = b"fLaC" + b"\0\0\0\x22" + bytes(10) + (96_000 << 44 | 1 << 41 | 23 << 36 | 96_000).to_bytes(8, "big") + bytes(16)
    assert C.header(flac) == (96_000, 8 * len(flac))
    mp3 = b"ID3\4\0\0\0\0\0\5" + b"\xff\xfb\x90\0x" + b"\xff\xfb\x90\0" + bytes(50)
    assert C.header(mp3) == (44_100, 128_000)
    assert C.header(b"FORM\0\0\0\0AIFFCOMM" + struct.pack(">IhIhHQ", 18, 2, 9, 16, 16383 + 15, 44_100 << 48)) == (44_100, 1_411_200)
    mp4 = b"\0\0\0\x18ftypM4A " + b"mdhd" + struct.pack(">IIIII", 0, 0, 0, 44_100, 88_200) + b"mp4a" + bytes(24) + struct.pack(">I", 44_100 << 16)
    assert C.header(mp4) == (44_100, 8 * len(mp4) // 2) and C.header(b"") == (0, 0) and C.header(b"\xff" * 9) == (0, 0)


def test_staging_files(spark, tmp_path):
    from cratewave.operators import dedupe

    for n in ("x", "y"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "dup.wav").write_bytes(n.encode())
    losers = spark.createDataFrame([(1, str(tmp_path / "x/dup.wav")), (2, str(tmp_path / "y/dup.wav")), (3, str(tmp_path / "gone.wav"))], "ord bigint, path string")
    plan = dedupe.stage_plan(losers, str(tmp_path / "out"))
    assert {r.status for r in dedupe.stage(plan, dry_run=True).collect()} == {"planned", "skipped"} and not (tmp_path / "out").exists()
    assert sorted(r.status for r in dedupe.stage(plan).collect()) == ["skipped", "success", "success"]
    assert (tmp_path / "out/dup.wav").read_bytes() == b"x" and (tmp_path / "out/dup_1.wav").read_bytes() == b"y" and (tmp_path / "x/dup.wav").exists()
    dedupe.stage(plan, move=True).collect()
    assert not (tmp_path / "x/dup.wav").exists()


def test_stem_cache_and_counts(spark, tmp_path):
    for n in ("one_m", "two_m"):
        (tmp_path / n).mkdir()
    assert C.clear_cache(str(tmp_path), ["one"]) == 1 and C.clear_cache(str(tmp_path)) == 1 and C.clear_cache(str(tmp_path / "none")) == 0
    df = spark.createDataFrame([("embed", "success"), ("embed", "error"), ("index", "skipped")], "stage string, status string")
    assert sorted(map(tuple, C.stage_counts(df).collect())) == [("embed", 1, 1, 0), ("index", 0, 0, 1)]


def test_profile_windows(spark):
    times = np.arange(0, 300, 0.1)
    onset = np.full(len(times), 0.1)
    for at in (5, 31, 60, 230, 236, 290):
        onset[int(at * 10)] = 1.0 + at / 1000
    rows = spark.createDataFrame([("a", float(t), float(x)) for t, x in zip(times, onset)], "path string, t double, x double")
    tracks = spark.createDataFrame([("a", 300.0), ("short", 4.0), ("none", 120.0)], "path string, duration double")
    got = {}
    for r in signal.profile_windows(rows, tracks).orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.start, r.end))
    a = got["a"]
    assert abs(a[0][0] - 31) < 0.2 and abs(a[0][1] - a[0][0] - 90) < 1e-6 and len(a) == 3
    assert all(y - x == 30 for x, y in a[1:]) and any(x >= 240 for x, _ in a[1:]) and abs(a[1][0] - a[2][0]) >= 10
    assert got["short"] == [(0.0, 0.0)] and got["none"] == [(10.0, 100.0)]
    early = rows.withColumn("x", F.when(F.col("t") > 280, 0.1).otherwise(F.col("x")))
    moved = [(r.start, r.end) for r in signal.profile_windows(early, tracks.where("path = 'a'")).orderBy("n").collect()]
    assert moved[-1] == (269.0, 299.0) or moved[-1][0] >= 240


def test_features_of_known_signals():
    rate = 22050
    t = np.arange(rate * 30) / rate
    low = np.sin(2 * np.pi * 80 * t)
    hz, sure = signal.bass_contour(low, rate)
    assert abs(np.median(hz) - 80) < 6 and sure == 1.0 and len(hz) == 1 + len(t) // 512
    clicks = np.zeros(len(t))
    clicks[:: rate // 2] = 1.0
    rhythm, even = signal.rhythm_contour(clicks, rate)
    peaks = np.flatnonzero(rhythm > 0.5)
    assert len(rhythm) == 256 and 0.9 < rhythm.max() <= 1.0 and rhythm.min() == 0.0 and abs(np.median(np.diff(peaks[np.r_[True, np.diff(peaks) > 2]])) - 21.5) <= 1 and 0 < even < 1
    assert signal.samples_score(np.zeros(rate * 5), rate) == 0.0 and 0 <= signal.samples_score(low * (1 + np.sin(t)) + clicks, rate) <= 1
    assert np.allclose(signal.mel(rate).sum(axis=1) * rate / 2048, 1, atol=0.25) and signal.steady(np.ones(500)).max() > 0.5


def test_decoding_widths(spark, tmp_path):
    import struct

    y = np.array([0.0, 0.5, -0.5, 0.25])
    files = []
    for kind, bits, data in ((1, 8, (y * 128 + 128).astype("u1").tobytes()), (1, 16, (y * 2**15).astype("<i2").tobytes()), (1, 24, b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in y)), (1, 32, (y * 2**31).astype("<i4").tobytes()), (3, 32, y.astype("<f4").tobytes())):
        fmt = struct.pack("<HHIIHH", kind, 1, 8000, 8000 * bits // 8, bits // 8, bits)
        files.append((f"/{kind}-{bits}", bytearray(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data)))
    comm = struct.pack(">hIh", 1, 4, 16) + struct.pack(">HQ", 16383 + 12, 8000 << 51)
    ssnd = struct.pack(">II", 0, 0) + (y * 2**15).astype(">i2").tobytes()
    files += [("/aiff", bytearray(b"FORM" + struct.pack(">I", 0) + b"AIFFCOMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">I", len(ssnd)) + ssnd)), ("/bad", bytearray(b"no")), ("/null", None)]
    got = {r.path: r for r in signal.decode(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert len(got) == len(files)
    for path, r in got.items():
        if path in ("/bad", "/null"):
            assert r.samples is None and r.error
        else:
            assert r.rate == 8000 and np.allclose(r.samples, y, atol=1e-2), (path, r)
    made = signal.encode(signal.decode(spark.createDataFrame(files, "path string, content binary")), lambda x, rate: [x.mean(), rate], "mean")
    assert {r.path: r.embedding for r in made.collect()}["/1-16"] == [0.0625, 8000.0]
    s = spark.createDataFrame([([0.0, 1e-4, -0.2], 2), ([0.0], 2), ([], 2), (None, 2), ([1.0], 0)], "samples array<double>, rate int")
    assert [r.t for r in s.select(signal.first_sound(F.col("samples"), F.col("rate")).alias("t")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_deck_source(spark, tmp_path):
    spark.dataSource.register(logs.deck_source())
    df = spark.readStream.format("decks").option("poll", "tests.decks:online").load()
    q = df.writeStream.format("memory").queryName("decks").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("decks").count() >= 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    r = spark.table("decks").orderBy("poll", "player").first()
    assert (r.player, r.title, r.tempo) == (1, "T", 128.0)


def test_user_tags(spark):
    import pytest

    from cratewave.operators import feedback

    t = feedback.add_tag(spark.createDataFrame([("/1", "a")], "path string, tag string"), "/1", "b")
    assert feedback.add_tag(t, "/1", "b").count() == 2 and feedback.remove_tag(t, "/1", "a").first().tag == "b" and feedback.available(["x", "y"], ["y", "z"]) == ["x", "y", "z"]
    with pytest.raises(ValueError):
        feedback.add_tag(t, "/1", "c", "ai")
