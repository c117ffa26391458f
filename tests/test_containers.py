import io
import struct
import wave
import zlib

import numpy as np
import pytest

from tessera.functions import containers, media


def bmp(pixels, bits=24, top_down=False, palette=None):
    h, w = pixels.shape[:2]
    if bits in (24, 32):
        rows = pixels[..., 2::-1]
        if bits == 32:
            rows = np.concatenate((rows, np.full((h, w, 1), 255, np.uint8)), 2)
        rows = rows.reshape(h, -1)
    else:
        packed = np.unpackbits(pixels[..., None].astype(np.uint8), axis=-1)[..., -bits:].reshape(h, -1)
        rows = np.packbits(packed, axis=1)
    stride = (w * bits + 31) // 32 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : rows.shape[1]] = rows
    body = (body if top_down else body[::-1]).tobytes()
    colours = b"" if palette is None else b"".join(bytes([*c[::-1], 0]) for c in palette.tolist())
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(body), 0, 0, 0 if palette is None else len(palette), 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(colours) + len(body), 0, 0, 54 + len(colours)) + head + colours + body, head, body


def png(pixels):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    h, w = pixels.shape[:2]
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels))) + chunk(b"IEND", b""))


def lzw(index, least):
    """The usual encoder: words of the table, of a size that grows with it."""
    clear = 1 << least
    table, size, out, held, bits = {bytes([i]): i for i in range(clear)}, least + 1, bytearray(), 0, 0
    after = clear + 2

    def put(code):
        nonlocal held, bits
        held |= code << bits
        bits += size
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(clear)
    word = b""
    for v in index.ravel().tolist():
        if word + bytes([v]) in table:
            word += bytes([v])
            continue
        put(table[word])
        if after < 4096:
            table[word + bytes([v])] = after
            if after == 1 << size and size < 12:
                size += 1
            after += 1
        else:
            put(clear)
            table, size, after = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        word = bytes([v])
    put(table[word])
    put(clear + 1)
    if bits:
        out.append(held & 255)
    return bytes(out)


def gif(frames, palette, interlaced=False, clear=None, at=(0, 0), screen=None, disposal=0):
    h, w = frames[0].shape
    bits = (len(palette) - 1).bit_length()
    out = b"GIF89a" + struct.pack("<HHBBB", *(screen or (w, h)), 0x80 | bits - 1, 0, 0) + palette.astype(np.uint8).tobytes()
    for f in frames:
        if clear is not None or disposal:
            out += b"\x21\xf9\x04" + struct.pack("<BHBB", (clear is not None) | disposal << 2, 5, clear or 0, 0)
        order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlaced else range(h)
        out += b"\x2c" + struct.pack("<HHHHB", *at, w, h, 0x40 if interlaced else 0) + bytes([max(2, bits)])
        data = lzw(f[list(order)], max(2, bits))
        for i in range(0, len(data), 255):
            out += bytes([len(data[i: i + 255])]) + data[i: i + 255]
        out += b"\0"
    return out + b"\x3b"


def avi(frames, kind, form):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    group = lambda name, body: chunk(b"LIST", name + body)
    strh = b"vids" + kind + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 2, 50, 0, len(frames), 0, 0, 0, 0, 0, 0, 0)
    audio = b"auds" + b"\0" * 52
    head = group(b"hdrl", chunk(b"avih", b"\0" * 56) + group(b"strl", chunk(b"strh", audio) + chunk(b"strf", b"\0" * 18)) + group(b"strl", chunk(b"strh", strh) + chunk(b"strf", form)))
    movi = group(b"movi", b"".join(chunk(b"00wb", b"abc") + chunk(b"01dc" if kind != b"DIB " else b"01db", f) for f in frames))
    body = b"AVI " + head + movi
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture
def pixels():
    return np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8)


def test_bmp(pixels):
    for bits in (24, 32):
        for top_down in (False, True):
            assert (containers.read_bmp(bmp(pixels, bits, top_down)[0]) == pixels).all()
    palette = np.random.default_rng(2).integers(0, 256, (16, 3), np.uint8)
    for bits in (1, 4, 8):
        index = np.random.default_rng(3).integers(0, 2 if bits == 1 else 16, (6, 11), np.uint8)
        assert (containers.read_bmp(bmp(index, bits, palette=palette[: 1 << min(bits, 4)])[0]) == palette[index]).all()
    assert media.read_image(bmp(pixels)[0]) == pytest.approx(pixels / 255)
    for bad in (b"BM", bmp(pixels)[0][:80], b"xx"):
        with pytest.raises((ValueError, struct.error)):
            containers.read_bmp(bad)


@pytest.mark.parametrize("colours", [2, 4, 16, 256])
def test_gif(colours):
    rng = np.random.default_rng(4)
    palette = rng.integers(0, 256, (colours, 3), np.uint8)
    frames = [np.repeat(rng.integers(0, colours, (40, 30), np.uint8), 4, 1), rng.integers(0, colours, (40, 120), np.uint8)]  # over 4096 words: the table is emptied
    for interlaced in (False, True):
        got = list(containers.read_gif(gif(frames, palette, interlaced)))
        assert len(got) == 2 and all((g == palette[f]).all() for g, f in zip(got, frames, strict=True))
    assert media.read_image(gif(frames, palette)) == pytest.approx(palette[frames[0]] / 255)
    assert len(media.read_video(gif(frames, palette))) == 2


def test_gif_transparency_and_disposal():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    frames = [np.full((2, 2), 1, np.uint8), np.array([[2, 3], [3, 2]], np.uint8)]
    got = list(containers.read_gif(gif(frames, palette, clear=3, at=(1, 1), screen=(4, 4))))
    assert got[1][1, 1].tolist() == [0, 255, 0] and got[1][1, 2].tolist() == [255, 0, 0] and got[1][0, 0].tolist() == [0, 0, 0]
    gone = list(containers.read_gif(gif(frames, palette, clear=3, disposal=2)))
    assert gone[1][0, 1].tolist() == [0, 0, 0]
    kept = list(containers.read_gif(gif(frames, palette, clear=3, disposal=3)))
    assert kept[1][0, 1].tolist() == [0, 0, 0] and kept[0][0, 1].tolist() == [255, 0, 0]
    with pytest.raises(ValueError):
        list(containers.read_gif(b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\0\x3b"))


def test_avi(spark, pixels):
    rng = np.random.default_rng(5)
    frames = [rng.integers(0, 256, (7, 5, 3), np.uint8) for _ in range(20)]
    plain = avi([bmp(f)[2] for f in frames], b"DIB ", bmp(pixels)[1])
    packed = avi([png(f) for f in frames], b"MPNG", struct.pack("<IiiHH4sIiiII", 40, 5, 7, 1, 24, b"MPNG", 0, 0, 0, 0, 0))
    for data in (plain, packed):
        rate, places, form = containers.read_avi(data)
        assert rate == 25 and len(places) == 20 and all((containers.avi_frame(data, p, form) == f).all() for p, f in zip(places, frames, strict=True))
        got = media.read_video(data)
        assert len(got) == 16 and got[0] == pytest.approx(frames[0] / 255) and got[-1] == pytest.approx(frames[-1] / 255)
    rows = spark.createDataFrame([(1, plain), (2, packed), (3, b"RIFF\0\0\0\0AVI ")], "id int, v binary")
    told = {r["id"]: r["m"] for r in rows.select("id", media.video("v", policy="warn").alias("m")).collect()}
    assert told[1]["features"] == told[2]["features"] == pytest.approx(media.video_features(np.stack(frames))) and told[3]["error"]
    with pytest.raises(ValueError):
        media.read_video(b"\0\0\0\x18ftypmp42")


def test_wave_of_24_bits():
    x = np.array([0, 1, -1, 2 ** 23 - 1, -2 ** 23, 12345, -54321])
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(3)
            w.setframerate(8000)
            w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x))
        rate, got = media.read_wave(f.getvalue())
    assert rate == 8000 and got == pytest.approx(x / 2 ** 23)
