"""Decoding of BMP, GIF and AVI files by their published layouts, without an image library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def _dib(data: bytes, width: int, height: int, bits: int, palette: np.ndarray | None) -> np.ndarray:
    """Uncompressed rows, each padded to four bytes, from the bottom up unless the height is negative."""
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if len(data) < stride * rows:
        raise ValueError("the picture ends early")
    raw = np.frombuffer(data, np.uint8, stride * rows).reshape(rows, stride)
    if bits in (24, 32):
        x = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[..., 2::-1]  # stored as blue, green, red
    elif bits in (1, 4, 8):
        spread = np.unpackbits(raw, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1]) if bits < 8 else raw
        index = spread[:, :width]
        x = palette[np.minimum(index, len(palette) - 1)] if palette is not None and len(palette) else index[..., None].astype(np.uint8)
    else:
        raise ValueError(f"{bits} bits a pixel")
    return (x[::-1] if height > 0 else x).astype(np.uint8)


def _palette(data: bytes, colours: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, min(len(data) // 4, colours) * 4).reshape(-1, 4)[:, 2::-1]


def read_bmp(data: bytes) -> np.ndarray:
    """Rows, columns and channels of an uncompressed BMP of 1, 4, 8, 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or packed == 3 and bits != 32:
        raise ValueError("only uncompressed BMP")
    used = struct.unpack_from("<I", data, 46)[0] if size >= 40 else 0
    return _dib(data[offset:], width, height, bits, _palette(data[14 + size: offset], used or 1 << bits) if bits <= 8 else None)


def _lzw(data: bytes, least: int, pixels: int) -> np.ndarray:
    """The codes of one GIF picture: words of growing size, a table that a clear code empties."""
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, size, held, bits, before = bytearray(), least + 1, 0, 0, b""
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size:
            code = held & ((1 << size) - 1)
            held >>= size
            bits -= size
            if code == clear or not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                size, before = least + 1, b""
                if code == clear:
                    continue
            if code == end:
                return np.frombuffer(bytes(out[:pixels].ljust(pixels, b"\0")), np.uint8)
            if code < len(table):
                word = table[code]
            elif code == len(table) and before:
                word = before + before[:1]
            else:
                raise ValueError("a broken GIF")
            out += word
            if before and len(table) < 4096:
                table.append(before + word[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            before = word
    return np.frombuffer(bytes(out[:pixels].ljust(pixels, b"\0")), np.uint8)


def read_gif(data: bytes) -> Iterator[np.ndarray]:
    """The frames of a GIF as shown: rows, columns and RGB, with transparency, offsets, interlace and disposal."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    colours = lambda n, at: np.frombuffer(data, np.uint8, 3 << n + 1, at).reshape(-1, 3)
    common = None
    if flags & 128:
        common = colours(flags & 7, at)
        at += 3 << (flags & 7) + 1
    canvas, clear, disposal = np.zeros((height, width, 3), np.uint8), -1, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:  # an extension: the graphic control tells transparency and disposal
            if data[at + 1] == 0xF9:
                packed, _, index = struct.unpack_from("<BHB", data, at + 3)
                clear, disposal = index if packed & 1 else -1, packed >> 2 & 7
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = common
            if flags & 128:
                own = colours(flags & 7, at)
                at += 3 << (flags & 7) + 1
            if own is None:
                raise ValueError("a GIF without colours")
            least, at, body = data[at], at + 1, bytearray()
            while data[at]:
                body += data[at + 1: at + 1 + data[at]]
                at += data[at] + 1
            at += 1
            index = _lzw(bytes(body), least, w * h).reshape(h, w)
            if flags & 64:  # lines come in four passes
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            before = canvas.copy()
            part = canvas[y: y + h, x: x + w]
            index = index[: part.shape[0], : part.shape[1]]
            seen = index != clear
            part[seen] = own[np.minimum(index, len(own) - 1)][seen]
            yield canvas.copy()
            if disposal == 2:
                canvas[y: y + h, x: x + w] = 0
            elif disposal == 3:
                canvas = before
            clear, disposal = -1, 0
        else:
            raise ValueError("a broken GIF")


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks of a RIFF list."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[float, list[tuple[int, int]], dict]:
    """Frames a second, the places of the first video stream's frames, and its format."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    rate, form, stream, number, frames = 0.0, None, None, 0, []

    def look(at: int, end: int) -> None:
        nonlocal rate, form, stream, number
        for name, a, b in _chunks(data, at, end):
            if name == b"LIST":
                kind = data[a: a + 4]
                if kind == b"strl":
                    video = False
                    for part, c, e in _chunks(data, a + 4, b):
                        if part == b"strh":
                            video = data[c: c + 4] == b"vids" and stream is None
                            if video:
                                scale, per = struct.unpack_from("<II", data, c + 20)
                                rate, stream = per / max(1, scale), number
                        elif part == b"strf" and video:
                            size, width, height, _, bits, packed = struct.unpack_from("<IiiHH4s", data, c)
                            form = {"width": width, "height": height, "bits": bits, "packed": packed, "palette": _palette(data[c + size: e], 256) if bits <= 8 else None}
                    number += 1
                elif kind in (b"hdrl", b"movi", b"rec "):
                    look(a + 4, b)
            elif stream is not None and name[:2] == b"%02d" % stream and name[2:] in (b"db", b"dc") and b > a:
                frames.append((a, b))

    look(12, len(data))
    if form is None or not frames:
        raise ValueError("an AVI without video")
    return rate, frames, form


def avi_frame(data: bytes, place: tuple[int, int], form: dict) -> np.ndarray:
    """One frame: uncompressed, or a PNG."""
    from .media import read_png

    part = data[place[0]: place[1]]
    if part[:4] == b"\x89PNG":
        return read_png(part)
    if form["packed"] in (b"\0\0\0\0", b"DIB ", b"RGB "):
        return _dib(part, form["width"], form["height"], form["bits"], form["palette"])
    raise ValueError(f"no decoder for {form['packed']!r} frames")
