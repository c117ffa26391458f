"""Image, audio and video: decoding, and features, in Arrow batches of numpy work.

Each kind has named features in a fixed order; a value that can't be read has
zeros and an error text, by the policy of ``guarded``.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import containers

GRID, LEVELS, SIDE = 3, 8, 48  # cells a side, histogram bins, side of the motion grid
RATE, FRAME, HOP, MEL, CEPSTRA, SEGMENTS = 16_000, 0.025, 0.010, 24, 13, 8
BANDS = [(0, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 6000), (6000, 8000)]
SUMMARY = ["mean", "std", "min", "q25", "median", "q75", "max"]
AUDIO_SECONDS = 30.0


# ---- numeric helpers

def entropy(values: np.ndarray, bins: int = 16) -> float:
    """Entropy in bits of a histogram; 0 for constant values."""
    x = np.asarray(values, float).ravel()
    x = x[np.isfinite(x)]
    if not len(x) or x.min() == x.max():
        return 0.0
    p = np.histogram(x, bins)[0] / len(x)
    return float(-(p[p > 0] * np.log2(p[p > 0])).sum())


def summarize(values: np.ndarray) -> list[float]:
    """``SUMMARY`` of finite values; zeros without any."""
    x = np.asarray(values, float).ravel()
    x = x[np.isfinite(x)]
    return [0.0] * len(SUMMARY) if not len(x) else [x.mean(), x.std(), x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max()]


def trend(values: np.ndarray) -> float:
    """The slope of the least-squares line through values at 0, 1, ..."""
    x = np.asarray(values, float)
    if len(x) < 2:
        return 0.0
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return float((t * (x - x.mean())).sum() / (t * t).sum())


# ---- decoding

def to_unit(pixels: np.ndarray) -> np.ndarray:
    """Pixels in [0, 1]: whole numbers by their type, reals as they are if inside, else between their 1 % and 99 % quantiles."""
    x = np.asarray(pixels)
    if x.dtype.kind in "ui":
        return x.astype(float) / np.iinfo(x.dtype).max
    x = np.nan_to_num(x.astype(float))
    if x.size and (x.min() < 0 or x.max() > 1):
        low, high = np.quantile(x, [0.01, 0.99])
        x = (x - low) / (high - low) if high > low else np.zeros_like(x)
    return np.clip(x, 0, 1)


def read_png(data: bytes) -> np.ndarray:
    """Rows, columns and channels of an 8-bit PNG without interlace (grey, RGB, palette, with or without alpha)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at: at + 8])
        part = data[at + 8: at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlace")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        line, above = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(width * channels, int)
        if raw[y, 0] == 0:
            out[y] = line
        elif raw[y, 0] == 2:
            out[y] = (line + above) & 255
        elif raw[y, 0] == 1:
            out[y] = (np.cumsum(line.reshape(width, channels), axis=0) & 255).ravel()
        else:
            now = np.zeros(width * channels, int)
            for i in range(width * channels):
                a, b, c = now[i - channels] if i >= channels else 0, above[i], above[i - channels] if i >= channels else 0
                p = a + b - c
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (line[i] + ((a + b) // 2 if raw[y, 0] == 3 else nearest)) & 255
            out[y] = now
    pixels = out.reshape(height, width, channels)
    return palette[pixels[..., 0]] if head[3] == 3 and palette is not None else pixels


def read_pnm(data: bytes) -> np.ndarray:
    """Rows, columns and channels of binary PGM (P5) and PPM (P6)."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at: at + 1].isspace():
            at += 1
        if data[at: at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end: end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, width, height, top = fields[0], *map(int, fields[1:])
    channels = {b"P5": 1, b"P6": 3}[kind]
    x = np.frombuffer(data[at + 1:], ">u2" if top > 255 else np.uint8, width * height * channels)
    return (x.astype(float) / top).reshape(height, width, channels)


def read_image(value: bytes | np.ndarray | list) -> np.ndarray:
    """Rows, columns and channels in [0, 1]: PNG, PGM, PPM, BMP and GIF (its first frame) here, other formats if an image library is there; arrays of two or three dimensions."""
    if isinstance(value, bytes | bytearray | memoryview):
        data = bytes(value)
        if data[:2] in (b"P5", b"P6"):
            x = read_pnm(data)
        elif data[:4] == b"\x89PNG":
            x = to_unit(read_png(data))
        elif data[:2] == b"BM":
            x = to_unit(containers.read_bmp(data))
        elif data[:4] == b"GIF8":
            x = to_unit(next(containers.read_gif(data)))
        else:
            from PIL import Image

            x = to_unit(np.asarray(Image.open(io.BytesIO(data)).convert("RGBA")))
    else:
        x = to_unit(np.asarray(value))
    if x.ndim == 2:
        x = x[..., None]
    if x.ndim != 3 or not x.size or x.shape[2] > 4:
        raise ValueError(f"no image of shape {x.shape}")
    return x


def read_wave(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1] of 8, 16, 24 or 32-bit WAV bytes."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() == 3:  # as the upper bytes of 32 bits
            raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8).reshape(-1, 3)
            wide = np.concatenate((np.zeros((len(raw), 1), np.uint8), raw), 1).copy().view("<i4")[:, 0]
            return w.getframerate(), wide.astype(float).reshape(-1, w.getnchannels()).mean(1) / 2.0 ** 31
        kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[w.getsampwidth()]
        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(float).reshape(-1, w.getnchannels()).mean(1)
        return w.getframerate(), (x - 128) / 128 if w.getsampwidth() == 1 else x / 2.0 ** (8 * w.getsampwidth() - 1)


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or len(x) < 2:
        return x
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def read_audio(value: bytes | np.ndarray | list | tuple, seconds: float = AUDIO_SECONDS) -> np.ndarray:
    """Mono samples at ``RATE``: WAV bytes, samples at that rate, or (rate, samples); channels are averaged, loud samples scaled to 1, long ones kept at their begin, middle and end."""
    if isinstance(value, bytes | bytearray | memoryview):
        rate, x = read_wave(bytes(value))
    elif isinstance(value, tuple) and len(value) == 2 and np.ndim(value[0]) == 0:
        rate, x = int(value[0]), np.asarray(value[1], float)
    else:
        rate, x = RATE, np.asarray(value, float)
    x = np.nan_to_num(x.mean(1) if x.ndim == 2 else x)
    top = np.abs(x).max() if len(x) else 0.0
    x = resample(x / top if top > 1.5 else x, rate)
    most = int(seconds * RATE)
    if len(x) > most:
        part = most // 3
        middle = (len(x) - part) // 2
        x = np.concatenate([x[:part], x[middle: middle + part], x[-part:]])
    return x


def sample_frames(n: int, most: int = 16) -> np.ndarray:
    """At most ``most`` evenly spaced numbers of n frames, the first and last among them."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(int)) if n else np.zeros(0, int)


def read_video(value, most: int = 16) -> list[np.ndarray]:
    """Frames in [0, 1]: arrays [frame, row, column(, channel)], (fps, frames), or a dict with frames; bytes of AVI (uncompressed or PNG frames) and GIF; evenly sampled.  Other containers need a decoder of their own."""
    if isinstance(value, dict):
        value = value["frames"]
    if isinstance(value, tuple) and len(value) == 2 and np.ndim(value[0]) == 0:
        value = value[1]
    if isinstance(value, bytes | bytearray | memoryview):
        data = bytes(value)
        if data[:4] == b"GIF8":
            every = list(containers.read_gif(data))
            return [read_image(every[i]) for i in sample_frames(len(every), most)]
        if data[8:12] == b"AVI ":
            _, places, form = containers.read_avi(data)  # only the sampled frames are decoded
            return [read_image(containers.avi_frame(data, places[i], form)) for i in sample_frames(len(places), most)]
    if isinstance(value, bytes | bytearray | memoryview | str):
        raise ValueError("no decoder for this video container is installed")
    x = np.asarray(value)
    if x.ndim not in (3, 4) or not x.size:
        raise ValueError(f"no video of shape {x.shape}")
    return [read_image(f) for f in to_unit(x)[sample_frames(len(x), most)]]


# ---- image features

def _resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal cells (nearest pixels where there are fewer)."""
    rows, columns = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(g.shape, (height, width), strict=True))
    at = lambda e, i, n: (min(e[i], n - 1), max(e[i + 1], min(e[i], n - 1) + 1))
    return np.array([[g[slice(*at(rows, i, g.shape[0])), slice(*at(columns, j, g.shape[1]))].mean() for j in range(width)] for i in range(height)])


def rgb_to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue, saturation and value in [0, 1]."""
    top, low = x.max(-1), x.min(-1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    r, g, b = ((top - x[..., k]) / safe for k in range(3))
    hue = np.where(x[..., 0] == top, b - g, np.where(x[..., 1] == top, 2 + r - b, 4 + g - r)) / 6 % 1
    return np.stack([np.where(span > 0, hue, 0), np.where(top > 0, span / np.where(top > 0, top, 1), 0), top], -1)


IMAGE = [
    "width", "height", "aspect", "alpha", "brightness", "contrast", "colourfulness", "dark_ratio", "bright_ratio", "entropy",
    "gradient_mean", "gradient_std", "gradient_density", *(f"orientation_{k}" for k in range(LEVELS)), "orientation_entropy", "laplacian", "symmetry_x", "symmetry_y",
    "blockiness", "centre_contrast", "low_frequency", "spectral_entropy",
    *(f"grid_{k}_{i}" for i in range(GRID * GRID) for k in ("brightness", "contrast", "saturation")),
    *(f"{c}_{k}" for c in ("red", "green", "blue") for k in ("mean", "std", "q10", "median", "q90", *(f"hist_{i}" for i in range(LEVELS)))),
    *(f"{c}_{k}" for c in ("hue", "saturation", "value") for k in ("mean", "std")),
]


def image_features(pixels) -> list[float]:
    """``IMAGE`` features of what ``read_image`` reads."""
    x = read_image(pixels)
    alpha = x[..., -1].mean() if x.shape[2] in (2, 4) else 1.0
    colour = x[..., :3] if x.shape[2] >= 3 else np.repeat(x[..., :1], 3, -1)
    g = colour @ np.array([0.299, 0.587, 0.114])
    h, w = g.shape
    dy = np.gradient(g, axis=0) if h > 1 else np.zeros_like(g)
    dx = np.gradient(g, axis=1) if w > 1 else np.zeros_like(g)
    m = np.hypot(dx, dy)
    turn = np.histogram(np.arctan2(dy, dx) % np.pi, LEVELS, (0, np.pi), weights=m)[0]
    turn = turn / turn.sum() if turn.sum() else turn
    told = turn[turn > 0]
    laplacian = (-4 * g[1:-1, 1:-1] + g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]).var() if min(h, w) > 2 else 0.0
    edge = lambda d, n: np.abs(d[n - 1:: n]).mean() if len(d[n - 1:: n]) else 0.0
    steps = [np.diff(g, axis=0), np.diff(g, axis=1).T]
    block = np.mean([edge(s, 8) - (np.abs(s).mean() if s.size else 0.0) for s in steps])
    centre = np.zeros((h, w), bool)
    centre[h // 4: h - h // 4, w // 4: w - w // 4] = True
    outer = g[~centre].mean() if (~centre).any() else g.mean()
    power = np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean()))) ** 2
    total = power.sum()
    low = power[h // 2 - h // 8: h // 2 + h // 8 + 1, w // 2 - w // 8: w // 2 + w // 8 + 1].sum() / total if total > 1e-12 else 1.0
    q = power.ravel() / total if total > 1e-12 else np.zeros(0)
    rg, yb = colour[..., 0] - colour[..., 1], (colour[..., 0] + colour[..., 1]) / 2 - colour[..., 2]
    hsv = rgb_to_hsv(colour)
    cells = []
    for rows in np.array_split(np.arange(h), GRID):
        for columns in np.array_split(np.arange(w), GRID):
            part = np.ix_(rows, columns)
            cells += [g[part].mean(), g[part].std(), hsv[..., 1][part].mean()] if len(rows) and len(columns) else [0.0] * 3
    channels = []
    for k in range(3):
        c = colour[..., k]
        channels += [c.mean(), c.std(), *np.quantile(c, [0.1, 0.5, 0.9]), *(np.histogram(c, LEVELS, (0, 1))[0] / c.size)]
    return [float(w), float(h), w / h, alpha, g.mean(), g.std(), np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()), (g < 0.1).mean(), (g > 0.9).mean(), entropy(g),
            m.mean(), m.std(), (m > 0.1).mean(), *turn, float(-(told * np.log2(told)).sum()), laplacian, 1 - np.abs(g - g[:, ::-1]).mean(), 1 - np.abs(g - g[::-1]).mean(),
            block, g[centre].mean() - outer if centre.any() else 0.0, low, float(-(q[q > 0] * np.log2(q[q > 0])).sum()), *cells, *channels,
            *(v for k in range(3) for v in (hsv[..., k].mean(), hsv[..., k].std()))]


# ---- audio features

def mel_filters(bins: int, rate: int = RATE, n: int = MEL) -> np.ndarray:
    """Triangular filters [n, bins] that are even on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    up = (f[None] - edges[:-2, None]) / np.maximum(edges[1:-1, None] - edges[:-2, None], 1e-9)
    down = (edges[2:, None] - f[None]) / np.maximum(edges[2:, None] - edges[1:-1, None], 1e-9)
    return np.maximum(0, np.minimum(up, down))


def cosine_transform(n: int, k: int) -> np.ndarray:
    """The orthonormal DCT-II [k, n]."""
    m = np.cos(np.pi * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None] / n) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


AUDIO = [
    "seconds", "mean", "std", "rms", "peak", "skew", "kurtosis", "crest", "zero_crossings", "silence", "clipping", "entropy", "rms_trend",
    *(f"{k}_{s}" for k in ("centroid", "bandwidth", "rolloff", "flatness", "spectral_entropy") for s in SUMMARY),
    *(f"band_{a}_{b}" for a, b in BANDS), *(f"mel_{i}" for i in range(MEL)), *(f"mfcc_{i}_{s}" for i in range(CEPSTRA) for s in ("mean", "std")),
    *(f"chroma_{i}" for i in range(12)), *(f"segment_{i}" for i in range(SEGMENTS)), "segment_trend",
]


def audio_features(value) -> list[float]:
    """``AUDIO`` features of what ``read_audio`` reads."""
    x = read_audio(value)
    if not len(x):
        return [0.0] * len(AUDIO)
    rms, top, std = np.sqrt((x * x).mean()), np.abs(x).max(), x.std()
    z = (x - x.mean()) / std if std > 1e-12 else np.zeros_like(x)
    size, hop = int(FRAME * RATE), int(HOP * RATE)
    padded = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    loud = np.sqrt((frames * frames).mean(1))
    s = np.abs(np.fft.rfft(frames * np.hanning(size), axis=1))
    f = np.fft.rfftfreq(size, 1 / RATE)
    total = np.maximum(s.sum(1), 1e-12)
    centroid = (s * f).sum(1) / total
    width = np.sqrt((s * (f[None] - centroid[:, None]) ** 2).sum(1) / total)
    up = np.cumsum(s, 1)
    rolloff = f[np.minimum((up < 0.85 * up[:, -1:]).sum(1), len(f) - 1)]
    flat = np.exp(np.log(s + 1e-12).mean(1)) / (s.mean(1) + 1e-12)
    p = s / total[:, None]
    spread = -(p * np.log2(p + 1e-12)).sum(1)
    power = (s * s).mean(0)
    whole = max(power.sum(), 1e-12)
    mel = np.log(s * s @ mel_filters(len(f)).T + 1e-10)
    mfcc = mel @ cosine_transform(MEL, CEPSTRA).T
    chroma = np.zeros(12)
    audible = f > 20
    np.add.at(chroma, np.round(12 * np.log2(f[audible] / 440)).astype(int) % 12, power[audible])
    segment = np.array([np.sqrt((part * part).mean()) if len(part) else 0.0 for part in np.array_split(x, SEGMENTS)])
    return [len(x) / RATE, x.mean(), std, rms, top, (z ** 3).mean(), (z ** 4).mean() - 3 if std > 1e-12 else 0.0, top / max(rms, 1e-12),
            float((np.diff(np.signbit(x).astype(int)) != 0).mean()) if len(x) > 1 else 0.0, (np.abs(x) < 0.01).mean(), (np.abs(x) > 0.99).mean(), entropy(x), trend(loud),
            *(v for k in (centroid, width, rolloff, flat, spread) for v in summarize(k)), *(power[(f >= a) & (f < b)].sum() / whole for a, b in BANDS), *mel.mean(0),
            *(v for i in range(CEPSTRA) for v in (mfcc[:, i].mean(), mfcc[:, i].std())), *(chroma / max(chroma.sum(), 1e-12)), *segment, trend(segment)]


# ---- video features

MOTION = ["motion_mean", "motion_std", "motion_max", "motion_trend", "cut_ratio"]
VIDEO = [*(f"{c}_{k}" for c in IMAGE for k in ("mean", "std", "trend")), *MOTION]


def motion_features(frames: list[np.ndarray]) -> list[float]:
    """``MOTION``: mean absolute differences of consecutive grey frames on a small grid."""
    if len(frames) < 2:
        return [0.0] * len(MOTION)
    small = np.stack([_resized(f[..., :3].mean(-1), min(SIDE, f.shape[0]), min(SIDE, f.shape[1])) for f in frames])
    d = np.abs(np.diff(small, axis=0)).mean((1, 2))
    return [d.mean(), d.std(), d.max(), trend(d), float((d > max(0.25, np.quantile(d, 0.9))).mean())]


def video_features(value) -> list[float]:
    """``VIDEO`` features of what ``read_video`` reads: each image feature's mean, deviation and trend over frames, and the motion."""
    frames = read_video(value)
    each = np.array([image_features(f) for f in frames])
    return [v for k in range(each.shape[1]) for v in (each[:, k].mean(), each[:, k].std(), trend(each[:, k]))] + motion_features(frames)


# ---- which features a budget keeps

ESSENTIAL = {"image": ["brightness", "contrast", "colourfulness", "entropy", "gradient_mean", "low_frequency"], "audio": ["rms", "zero_crossings", "centroid_mean", "rolloff_mean", "mfcc_0_mean", "mfcc_1_mean"],
             "video": [*MOTION, "brightness_mean"]}
NAMES = {"image": IMAGE, "audio": AUDIO, "video": VIDEO}


def feature_order(kind: str) -> list[str]:
    """All features of a kind: the essential ones, then the groups (names up to the last underscore) in turn."""
    names = NAMES[kind]
    groups: dict[str, list[str]] = {}
    for n in names:
        if n not in ESSENTIAL[kind]:
            groups.setdefault(n.rstrip("0123456789").rstrip("_").rsplit("_", 1)[0], []).append(n)
    out = list(ESSENTIAL[kind])
    while any(groups.values()):
        out += [g.pop(0) for g in groups.values() if g]
    return out


# ---- columns

MESSAGES = 20


def guarded(work: Callable, size: int, policy: str = "zero"):
    """A pandas UDF of one column: struct of features and error.

    ``zero`` gives zeros for what can't be read, ``warn`` tells so in error as
    well, ``error`` fails the job.  Null is zeros without an error.
    """

    @F.arrow_udf("struct<features: array<double>, error: string>")
    def run(rows: pa.Array) -> pa.Array:
        features, errors, told = np.zeros((len(rows), size)), [None] * len(rows), 0
        for i, r in enumerate(rows):  # one value at a time, and numbers in one block
            r = _plain(r)
            if r is None or not len(r):
                continue
            try:
                features[i] = np.nan_to_num(np.asarray(work(r), float))
            except Exception as e:
                if policy == "error":
                    raise
                errors[i] = f"{type(e).__name__}: {e}" if policy == "warn" and told < MESSAGES else None
                told += 1
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * size + 1, size, dtype=np.int32)), pa.array(features.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], names=["features", "error"])

    return run


def _plain(value: pa.Scalar):
    """Bytes, or an array column's value as numpy."""
    if not value.is_valid:
        return None
    return value.values.to_numpy(zero_copy_only=False) if isinstance(value, pa.ListScalar) else value.as_py()


def image(column: str, height: int | None = None, width: int | None = None, policy: str = "zero") -> Column:
    """``IMAGE`` features of a column of image bytes, or of flat arrays of height * width pixels."""
    work = image_features if height is None else lambda x: image_features(np.asarray(x, float).reshape(height, width))
    return guarded(work, len(IMAGE), policy)(column)


def audio(column: str, rate: int = RATE, policy: str = "zero") -> Column:
    """``AUDIO`` features of a column of WAV bytes or of arrays of samples."""
    work = lambda x: audio_features(x if isinstance(x, bytes) else (rate, np.asarray(x, float)))
    return guarded(work, len(AUDIO), policy)(column)


def video(column: str, frames: int | None = None, height: int | None = None, policy: str = "zero") -> Column:
    """``VIDEO`` features of a column of AVI or GIF bytes, or of flat arrays of ``frames`` equal grey frames (one row high if no height is given)."""
    work = video_features if frames is None else lambda x: video_features(np.asarray(x, float).reshape(frames, height or 1, -1))
    return guarded(work, len(VIDEO), policy)(column)


def motion(column: str, frames: int) -> Column:
    """``MOTION`` of flat arrays of equal frames, JVM-side: the frames are slices of the array."""
    size = F.size(column) / frames
    part = lambda i: F.slice(column, (i * size + 1).cast("int"), size.cast("int"))
    step = F.transform(F.sequence(F.lit(1), F.lit(frames - 1)), lambda i: F.aggregate(F.zip_with(part(i), part(i - 1), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / size)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = float(frames - 1)
    mean = total(step) / n
    middle = (n - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(frames - 1)) or 1.0
    slope = total(F.transform(step, lambda x, i: (i - middle) * x)) / spread
    order, at = F.array_sort(step), 0.9 * (n - 1)
    q90 = F.get(order, F.lit(int(at))) + (at - int(at)) * (F.get(order, F.lit(min(int(at) + 1, frames - 2))) - F.get(order, F.lit(int(at))))
    cuts = F.size(F.filter(step, lambda x: x > F.greatest(F.lit(0.25), q90))) / n
    return F.array(mean, F.sqrt(total(F.transform(step, lambda x: (x - mean) ** 2)) / n), F.array_max(step), slope, cuts)
