"""Grey TIFF images: classic and big files of either byte order, strips and tiles, several pages, plain or compressed."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from glowtrace.errors import RecordingError

# Tags, and the struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
LZW_CLEAR, LZW_END, LZW_FIRST = 256, 257, 258


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; a code's width grows one entry before its table is full."""
    out = bytearray()
    table: list[bytes] = []
    held = bits = 0
    width, last = 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == LZW_CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == LZW_END or len(out) >= size:
            break
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise RecordingError("damaged LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    """Runs: n < 128 is followed by n + 1 bytes as they are, n > 128 by one byte that comes 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


UNPACK = {
    1: lambda data, size: data,
    5: unpack_lzw,
    8: lambda data, size: zlib.decompress(data),
    32946: lambda data, size: zlib.decompress(data),
    32773: unpack_bits,
}


@dataclass(frozen=True)
class Page:
    """One image's directory: the values of its tags and the file's byte order."""

    tags: dict[int, tuple[int, ...]]
    order: str

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise RecordingError(f"a TIFF image without tag {tag}")
        return self.tags[tag][0] if tag in self.tags else default

    def image(self, data: bytes) -> np.ndarray:
        if self.one(SAMPLES, 1) != 1:
            raise RecordingError("only grey images are read")
        unpack = UNPACK.get(self.one(COMPRESSION, 1))
        if unpack is None:
            raise RecordingError(f"TIFF compression {self.one(COMPRESSION)} is not read")
        bits, form = self.one(BITS, 8), {1: "u", 2: "i", 3: "f"}.get(self.one(SAMPLE_FORMAT, 1))
        if bits not in (8, 16, 32, 64) or form is None or (form == "f" and bits < 16):
            raise RecordingError(f"samples of {bits} bits are not read")
        kind = np.dtype(f"{self.order}{form}{bits // 8}")
        h, w = self.one(HEIGHT), self.one(WIDTH)
        if TILE_OFFSETS in self.tags:
            th, tw, places, sizes = self.one(TILE_HEIGHT), self.one(TILE_WIDTH), self.tags[TILE_OFFSETS], self.tags[TILE_BYTES]
        else:
            th, tw, places, sizes = min(self.one(STRIP_ROWS, h), h), w, self.tags[STRIP_OFFSETS], self.tags[STRIP_BYTES]
        across = -(-w // tw)
        out = np.zeros((h, w), kind)
        for i, (place, size) in enumerate(zip(places, sizes, strict=True)):
            y, x = i // across * th, i % across * tw
            rows = th if TILE_OFFSETS in self.tags else min(th, h - y)
            raw = unpack(data[place : place + size], rows * tw * kind.itemsize)
            if len(raw) < rows * tw * kind.itemsize:
                raise RecordingError("a TIFF image is cut off")
            part = self._predicted(raw[: rows * tw * kind.itemsize], rows, tw, kind)
            out[y : y + rows, x : x + tw] = part[: h - y, : w - x]
        return out

    def _predicted(self, raw: bytes, rows: int, columns: int, kind: np.dtype) -> np.ndarray:
        """Differences along rows added up; those of floating numbers are of their bytes, the highest of all samples first."""
        predictor = self.one(PREDICTOR, 1)
        if predictor == 2 and kind.kind in "ui":
            return np.cumsum(np.frombuffer(raw, kind).reshape(rows, columns), axis=1, dtype=kind.newbyteorder("="))
        if predictor == 3 and kind.kind == "f":
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
        if predictor != 1:
            raise RecordingError(f"TIFF predictor {predictor} is not read for {kind}")
        return np.frombuffer(raw, kind).reshape(rows, columns)


def pages(data: bytes) -> list[Page]:
    """The images of a file, in the order of their chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise RecordingError("not a TIFF file")
    big = version == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack_from(order + word, data, 8 if big else 4)[0]
    out, seen = [], set()
    while at:
        if at in seen or at >= len(data):
            raise RecordingError("a TIFF file's chain of images is damaged")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        first, tags = at + struct.calcsize(order + count), {}
        for i in range(first, first + entry * n, entry):
            tag, kind = struct.unpack_from(order + "HH", data, i)
            if kind in FIELD_TYPES:
                values = struct.unpack_from(order + word, data, i + 4)[0]
                form = f"{order}{values}{FIELD_TYPES[kind]}"
                place = i + 4 + struct.calcsize(order + word)
                inside = struct.calcsize(form) <= struct.calcsize(order + word)
                tags[tag] = struct.unpack_from(form, data, place if inside else struct.unpack_from(order + word, data, place)[0])
        out.append(Page(tags, order))
        at = struct.unpack_from(order + word, data, first + entry * n)[0]
    return out


def decode(data: bytes, page: int = 0) -> np.ndarray:
    """A page of a file as an image of its own kind of samples."""
    found = pages(data)
    if not 0 <= page < len(found):
        raise RecordingError(f"no page {page} among {len(found)}")
    return found[page].image(data)


def encode(image: np.ndarray) -> bytes:
    """One plain strip, little-endian, whole or floating numbers of 8 to 64 bits."""
    image = np.ascontiguousarray(image.astype(image.dtype.newbyteorder("<")))
    h, w = image.shape
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, image.itemsize * 8), (COMPRESSION, 3, 1), (262, 3, 1), (STRIP_OFFSETS, 4, 8 + 2 + 12 * 10 + 4), (SAMPLES, 3, 1), (STRIP_ROWS, 4, h), (STRIP_BYTES, 4, image.nbytes), (SAMPLE_FORMAT, 3, form)]
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + b"\0\0\0\0" + image.tobytes()
