"""Features of decoded audio, as functions of arrays and operators over tables of signals.

Everything takes a table (path, samples array<float>, rate int) of mono signals, one row per track."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pcm(content: bytes, seconds: float) -> tuple[np.ndarray, int] | None:
    """Mono signal and rate of a RIFF or AIFF file with plain samples: 8, 16, 24 or 32 bits, or floats; None for others."""
    riff = content[:4] == b"RIFF" and content[8:12] == b"WAVE"
    if not riff and not (content[:4] == b"FORM" and content[8:12] in (b"AIFF", b"AIFC")):
        return None
    end, at, form, data = "<" if riff else ">", 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack(end + "I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            form = (channels, rate, bits, {1: "i", 3: "f"}.get(kind), "<")
        elif name == b"COMM" and len(body) >= 18:
            channels, _, bits = struct.unpack(">hIh", body[:8])
            exponent, mantissa = struct.unpack(">HQ", body[8:18])
            order = {b"NONE": ("i", ">"), b"sowt": ("i", "<"), b"fl32": ("f", ">"), b"FL32": ("f", ">"), b"fl64": ("f", ">")}.get(body[18:22] or b"NONE", (None, ">"))
            form = (channels, int(mantissa * 2.0 ** (exponent - 16446)), bits, *order)
        elif name == b"data":
            data = body
        elif name == b"SSND":
            data = body[8 + struct.unpack(">I", body[:4])[0] :] if len(body) >= 8 else b""
        at += 8 + size + (size & 1)
    if form is None or form[3] is None or form[0] < 1 or form[1] < 1:
        return None
    channels, rate, bits, kind, order = form
    width = (bits + 7) // 8
    n = min(len(data) // (width * channels), int(seconds * rate)) * channels
    raw = np.frombuffer(data[: n * width], np.uint8)
    if kind == "f" and width in (4, 8):
        y = raw.view(f"{order}f{width}").astype(np.float64)
    elif kind == "i" and width == 1 and riff:
        y = raw.astype(np.float64) / 128 - 1  # the only unsigned one
    elif kind == "i" and width in (1, 2, 3, 4):
        wide = np.zeros((n, 4), np.uint8)  # into the upper bytes of 32 bits
        wide[:, 4 - width :] = raw.reshape(n, width) if order == "<" else raw.reshape(n, width)[:, ::-1]
        y = wide.view("<i4")[:, 0] / 2.0**31
    else:
        return None
    return y.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def decode(files: DataFrame, seconds: float = 90.0, other: Callable[[bytes, float], tuple[np.ndarray, int]] | None = None) -> DataFrame:
    """(path, samples, rate, error) of binary files (path, content), at most so many seconds each. Plain samples in RIFF
    and AIFF files are read here; other files by `other` (content, seconds), else by `soundfile` where it is installed.
    No file is left out: one that cannot be decoded has no samples and says why."""

    def load(content: bytes | None) -> tuple[np.ndarray, int]:
        found = pcm(content or b"", seconds)
        if found is None and other is not None:
            found = other(content, seconds)
        if found is None:
            import soundfile

            data, rate = soundfile.read(io.BytesIO(content or b""), dtype="float32", always_2d=True)
            found = data[: int(seconds * rate)].mean(axis=1), rate
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                y = rate = error = None
                try:
                    y, rate = load(content)
                except Exception as e:  # whatever a decoder raises for one file must not stop the others
                    error = f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([y], pa.list_(pa.float32())), pa.array([rate], pa.int32()), pa.array([error], pa.string())], ["path", "samples", "rate", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, samples array<float>, rate int, error string")


def encode(signals: DataFrame, model: Callable[[np.ndarray, int], np.ndarray], name: str) -> DataFrame:
    """(path, embedding, embedding_source) of decoded signals by an encoder (mono signal, rate) -> vector, such as a neural
    network that the caller loads in the task; rows without samples have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if not y else np.asarray(model(np.asarray(y, np.float32), r), np.float32).tolist() for y, r in zip(b.column("samples").to_pylist(), b.column("rate").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(vectors, pa.list_(pa.float32())), pa.array([name] * len(vectors), pa.string())], ["path", "embedding", "embedding_source"])

    return signals.select("path", "samples", "rate").mapInArrow(run, "path string, embedding array<float>, embedding_source string")


def first_sound(samples: Column, rate: Column, least: float = 1e-4) -> Column:
    """Seconds until the first sample louder than a threshold; 0 if there is none, and for no samples or no rate."""
    loud = F.array_position(F.transform(samples, lambda x: F.abs(x) > F.lit(least)), True)
    return F.coalesce(F.when((rate > 0) & (loud > 0), (loud - 1) / rate), F.lit(0.0))


def spectrum(y: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Magnitudes (frames, bins) of a signal under a Hann window; short signals give one padded frame."""
    if len(y) < size:
        y = np.pad(y, (0, size - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))


def onset_strength(y: np.ndarray, rate: int, hop: int = 512) -> np.ndarray:
    """Rise of log magnitude from frame to frame, averaged over bins."""
    s = np.log1p(spectrum(y, hop=hop))
    return np.concatenate([[0.0], np.maximum(0, np.diff(s, axis=0)).mean(axis=1)])


def estimate_tempo(onset: np.ndarray, rate: int, hop: int = 512, low: float = 60.0, high: float = 200.0) -> float:
    """Tempo whose lag has the highest autocorrelation of onset strength, weighted towards 120; 0 for silence."""
    x = onset - onset.mean()
    if len(x) < 4 or not np.any(x):
        return 0.0
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)]
    lags = np.arange(1, len(x))
    bpm = 60.0 * rate / hop / lags
    weight = np.exp(-0.5 * np.log2(bpm / 120.0) ** 2) * ((bpm >= low) & (bpm <= high))
    score = r[1:] * weight
    return float(bpm[score.argmax()]) if score.max() > 0 else 0.0


def chroma(y: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the 12 pitch classes from C, between 55 and 5000 Hz."""
    size = 8192
    energy = spectrum(y, size=size, hop=4096).mean(axis=0)
    f = np.fft.rfftfreq(size, 1 / rate)
    keep = (f >= 55) & (f <= 5000)
    pitch = np.round(12 * np.log2(f[keep] / 440.0) + 69).astype(int) % 12
    return np.bincount(pitch, energy[keep], 12)


def centred(y: np.ndarray, size: int, hop: int = 512) -> np.ndarray:
    """Magnitudes (frames, bins) of frames around every `hop`-th sample, under a periodic Hann window, zeros outside."""
    y = np.pad(np.asarray(y, np.float64), size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frames * window, axis=1))


def rises(s: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Mean rise of a spectrogram (frames, bins) from frame to frame, moved to the middle of the frames."""
    rise = np.maximum(0.0, np.diff(s, axis=0)).mean(axis=1) if s.shape[1] else np.zeros(max(0, len(s) - 1))
    return np.concatenate([np.zeros(1 + size // (2 * hop)), rise])[: len(s)]


def mel(rate: int, size: int = 2048, bands: int = 128) -> np.ndarray:
    """Weights (bands, bins) of triangles of equal area on a scale that is linear up to 1 kHz and logarithmic above."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * step))
    edges = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), bands + 2))
    f, width = np.fft.rfftfreq(size, 1 / rate), np.diff(edges)
    up, down = (f - edges[:-2, None]) / width[:-1, None], (edges[2:, None] - f) / width[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def loudness_rises(y: np.ndarray, rate: int) -> np.ndarray:
    """Onset strength: rises of the decibels of mel bands, down to 80 below the loudest."""
    db = 10 * np.log10(np.maximum(1e-10, centred(y, 2048) ** 2 @ mel(rate).T))
    return rises(np.maximum(db, db.max() - 80))


def steady(x: np.ndarray, size: int = 2048, kernel: int = 31, margin: float = 3.0) -> np.ndarray:
    """The steady part of a series: of its spectrogram what stands out along time against what stands out along
    frequency, by medians over `kernel` neighbours, turned back into a series."""
    n, hop = len(x), size // 4
    padded = np.pad(x, size // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    spec = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * window, axis=1)
    medians = lambda m, axis: np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, [(kernel // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], "symmetric"), kernel, axis=axis), axis=-1)
    along, across = medians(np.abs(spec), 0), medians(np.abs(spec), 1) * margin
    top = np.maximum(along, across)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(top > np.finfo(np.float32).tiny, (along / top) ** 2 / ((along / top) ** 2 + (across / top) ** 2), 0.0)
    frames = np.fft.irfft(spec * share, size, axis=1) * window
    out, weight = np.zeros(size + hop * (len(frames) - 1)), np.zeros(size + hop * (len(frames) - 1))
    for i, frame in enumerate(frames):
        out[i * hop : i * hop + size] += frame
        weight[i * hop : i * hop + size] += window**2
    return np.divide(out, weight, out=out.copy(), where=weight > np.finfo(np.float32).tiny)[size // 2 : size // 2 + n]


def samples_score(y: np.ndarray, rate: int) -> float:
    """Presence of sampled sounds in breaks, between 0 and 1: onsets between 500 and 4000 Hz, of more than median strength,
    within 8 seconds of the two quietest breaks, per three minutes, by 1 - exp(-n / 8). A break is a local minimum of the
    steady loudness below its 40th percentile; without breaks the score is 0."""
    s = centred(y, 2048)
    f = np.linspace(0, rate / 2, s.shape[1])
    onset = rises(s[:, (f >= 500) & (f <= 4000)])
    power = s**2
    power[:, [0, -1]] *= 0.5
    loud = steady(np.sqrt(2 * power.sum(axis=1) / 2048**2))
    loud = loud / max(np.abs(loud).max(), np.finfo(np.float32).tiny)
    before, after = np.r_[True, np.diff(loud) < 0], np.r_[np.diff(loud) > 0, True]
    low = np.flatnonzero((loud < np.percentile(loud, 40)) & before & after)
    if not len(low):
        return 0.0
    reach, middle = int(8.0 * rate / 512), np.median(onset)
    total = sum(int((onset[max(0, c - reach) : c + reach] > middle).sum()) for c in low[np.argsort(loud[low], kind="stable")[:2]])
    return float(np.clip(1 - np.exp(-total / max(1.0, (len(onset) - 1) * 512 / rate / 180) / 8), 0, 1))


def bass_contour(y: np.ndarray, rate: int) -> tuple[np.ndarray, float]:
    """(loudest frequency between 40 and 200 Hz of each frame, reliability 0..1). Frames are smoothed by the median over
    their 2 * ceil(sqrt(n)) nearest in time; the reliability is a fifth of the median ratio of peak and median."""
    s = centred(y, 4096)
    f = np.linspace(0, rate / 2, s.shape[1])
    band = (f >= 40) & (f <= 200)
    s, f = s[:, band], f[band]
    reliable = float(np.clip(np.median(s.max(axis=1) / (np.median(s, axis=1) + 1e-6)) / 5, 0, 1))
    raw = f[s.argmax(axis=1)]
    k = int(np.ceil(np.sqrt(len(raw))))
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(raw, k, "symmetric"), 2 * k + 1), axis=1), reliable


def rhythm_contour(y: np.ndarray, rate: int, points: int = 256) -> tuple[np.ndarray, float]:
    """(onset strength between 0 and 1, cut or padded to a length, and its reliability: twice the share above a half)."""
    onset = loudness_rises(y, rate)
    onset = onset - onset.min()
    onset = onset / onset.max() if onset.max() > 0 else onset
    return np.pad(onset[:points], (0, max(0, points - len(onset)))), float(np.clip(2 * (onset > 0.5).mean(), 0, 1))


def pick_tails(energy: np.ndarray, times: np.ndarray, n: int, min_gap: float) -> list[float]:
    """Times of the n highest local peaks that lie at least `min_gap` apart, in order of height."""
    inner = np.flatnonzero((energy[1:-1] >= energy[:-2]) & (energy[1:-1] > energy[2:])) + 1 if len(energy) > 2 else np.empty(0, int)
    out: list[float] = []
    for i in sorted(inner, key=lambda i: (-energy[i], i)):
        if len(out) < n and all(abs(times[i] - t) >= min_gap for t in out):
            out.append(float(times[i]))
    return out


def features(signals: DataFrame) -> DataFrame:
    """(path, bpm, chroma, samples, bass, bass_reliability, rhythm, rhythm_reliability) of decoded signals; those without
    samples are left out."""
    floats = pa.list_(pa.float64())
    fields = {"path": pa.string(), "bpm": pa.float64(), "chroma": floats, "samples": pa.float64(), "bass": floats, "bass_reliability": pa.float64(), "rhythm": floats, "rhythm_reliability": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, y, rate in zip(b.column("path").to_pylist(), b.column("samples").to_pylist(), b.column("rate").to_pylist()):
                if not y:
                    continue
                y = np.asarray(y, np.float32)
                (bass, sure), (rhythm, even) = bass_contour(y, rate), rhythm_contour(y, rate)
                out.append((path, round(estimate_tempo(onset_strength(y, rate), rate), 2), chroma(y, rate).tolist(), samples_score(y, rate), bass.tolist(), sure, rhythm.tolist(), even))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(fields.values())], list(fields))

    kinds = {pa.string(): "string", pa.float64(): "double", floats: "array<double>"}
    return signals.select("path", "samples", "rate").mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in fields.items()))


#: The settings of the standard sampling profile, in seconds and shares.
STANDARD = {"start_skip_s": 10.0, "main_len_s": 90.0, "tail_region": 0.7, "n_tail": 2, "tail_len_s": 30.0, "min_gap_s": 10.0, "force_tail_in_last_60s": True, "energy_onset_align": True}


def _peaks(rows: DataFrame, percentile: float, gap: float, key: str) -> DataFrame:
    """Onset rows (key, t, x) that are local maxima of at least a percentile of the rows: (key, t, x). A plateau counts at
    its middle; the highest go first, and what lies nearer than a gap to one that stays is dropped."""
    order = Window.partitionBy(key).orderBy("t")
    # runs of equal values: a plateau is a peak if it is left upwards and followed downwards
    starts = rows.withColumn("first", F.coalesce(F.col("x") != F.lag("x").over(order), F.lit(True)).cast("int")).withColumn("run", F.sum("first").over(order))
    runs = starts.groupBy(key, "run").agg(F.first("x").alias("x"), F.array_sort(F.collect_list("t")).alias("times"), F.count("*").alias("n"))
    along = Window.partitionBy(key).orderBy("run")
    runs = runs.withColumns({"before": F.lag("x").over(along), "after": F.lead("x").over(along)})
    limit = rows.groupBy(key).agg(F.percentile("x", F.lit(percentile)).alias("limit"), ((F.max("t") - F.min("t")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("step"))
    high = runs.join(limit, key).where("before < x and after < x and x >= limit").withColumn("t", F.expr("times[cast((n - 1) div 2 as int)]"))
    listed = high.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", F.col("t").alias("t"))), asc=False).alias("p"), F.first("step").alias("step"))
    # a fold over the peaks of one track, whose length bounds their number
    far = lambda kept, p: ~F.exists(kept, lambda q: F.abs(q["t"] - p["t"]) < F.greatest(F.lit(gap), F.col("step")) - F.col("step") * 0.5)
    none = F.filter("p", lambda _: F.lit(False))
    kept = F.aggregate("p", none, lambda got, p: F.when(far(got, p), F.concat(got, F.array(p))).otherwise(got))
    return listed.select(key, F.explode(kept).alias("p")).select(key, "p.t", "p.x")


def profile_windows(onsets: DataFrame, tracks: DataFrame, settings: dict | None = None, key: str = "path") -> DataFrame:
    """(key, n, start, end): windows to sample of tracks (key, duration) by their onset rows (key, t, x). The first is a long
    one from the first strong onset after the intro, or the strongest where none is a peak; the others are shorter ones at
    the strongest onsets of the last part, at least a gap apart, of which one lies in the last minute of a long track.
    Tracks without onset rows have the first window only."""
    s = STANDARD | (settings or {})
    length, rows = F.col("duration"), onsets.join(tracks.select(key, "duration"), key)
    rest = F.greatest(F.lit(0.0), length - 5.0)
    intro = rows.where(F.col("t") >= s["start_skip_s"]).select(key, "t", "x")
    starts = intro.groupBy(key).agg(F.max_by("t", F.struct("x", -F.col("t"))).alias("top")).join(_peaks(intro, 0.75, 5.0, key).groupBy(key).agg(F.min("t").alias("peak")), key, "left")
    first = tracks.select(key, "duration").join(starts, key, "left").withColumn("start", F.coalesce("peak", "top") if s["energy_onset_align"] else F.lit(None).cast("double"))
    first = first.withColumn("start", F.coalesce("start", F.least(F.lit(float(s["start_skip_s"])), rest)))
    first = first.select(key, F.lit(0).alias("n"), "start", F.least(F.col("start") + s["main_len_s"], rest).alias("end"))
    late = _peaks(rows.where(F.col("t") >= length * s["tail_region"]).select(key, "t", "x"), 0.6, float(s["min_gap_s"]), key).join(tracks.select(key, "duration"), key)
    tails = late.withColumn("t", F.least("t", length - s["tail_len_s"] - 1.0)).groupBy(key).agg(F.first("duration").alias("duration"), F.sort_array(F.collect_list(F.struct("x", "t")), asc=False).alias("p"))
    apart = lambda got, p: (F.size(got) < s["n_tail"]) & ~F.exists(got, lambda q: F.abs(q - p["t"]) < s["min_gap_s"])
    chosen = F.aggregate("p", F.array().cast("array<double>"), lambda got, p: F.when(apart(got, p), F.concat(got, F.array(p["t"]))).otherwise(got))
    tails = tails.withColumn("c", chosen).where(F.size("c") > 0)
    if s["force_tail_in_last_60s"]:
        early = (length > 90) & F.forall("c", lambda t: t < length - 60)
        moved = F.concat(F.slice("c", 1, F.size("c") - 1), F.array(F.greatest(length - 60, length - s["tail_len_s"] - 1.0)))
        tails = tails.withColumn("c", F.when(early, moved).otherwise(F.col("c")))
    others = tails.select(key, F.posexplode("c").alias("n", "start")).select(key, (F.col("n") + 1).alias("n"), "start", (F.col("start") + s["tail_len_s"]).alias("end"))
    return first.unionByName(others)


def onset_rows(signals: DataFrame, hop: int = 1024) -> DataFrame:
    """(path, t, x): onset strength of decoded signals, every `hop` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, y, rate in zip(b.column("path").to_pylist(), b.column("samples").to_pylist(), b.column("rate").to_pylist()):
                if y:
                    db = 10 * np.log10(np.maximum(1e-10, centred(np.asarray(y), 2048, hop) ** 2 @ mel(rate).T))
                    x = rises(np.maximum(db, db.max() - 80), 2048, hop)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(x), pa.string()), pa.array(np.arange(len(x)) * hop / rate), pa.array(x)], ["path", "t", "x"])

    return signals.select("path", "samples", "rate").mapInArrow(run, "path string, t double, x double")
