"""TIFF files made here of every kind that is read: byte orders, sizes, strips, tiles, pages, compressions, predictors."""

import struct
import zlib

import numpy as np
import pytest

from glowtrace.errors import RecordingError
from glowtrace.sources import tiff


def pack_lzw(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    codes, width, size, held = [(256, 9)], 9, 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if held + c in table:
            held += c
            continue
        codes.append((table[held], width))
        table[held + c] = size
        size += 1
        if size == 4095:
            codes.append((256, width))
            table, width, size = {bytes([j]): j for j in range(256)}, 9, 258
        elif size >= 1 << width:
            width += 1
        held = c
    if held:
        codes.append((table[held], width))
        size += 1
        width += size >= 1 << width and width < 12
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (257, width)])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and data[i : i + 1] * (n + 1) == data[i : i + n + 1]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
            i += n
        else:
            part = data[i : i + 3]
            out += bytes([len(part) - 1]) + part
            i += len(part)
        out += b"\x80"  # does nothing
    return bytes(out)


PACK = {1: lambda d: d, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}


def differences(part, predictor):
    if predictor == 2:
        return np.diff(part, axis=1, prepend=part.dtype.type(0))
    if predictor == 3:
        planes = part.astype(part.dtype.newbyteorder(">")).view(np.uint8).reshape(*part.shape, part.itemsize).transpose(0, 2, 1).reshape(len(part), -1)
        return np.diff(planes, axis=1, prepend=np.uint8(0))
    return part


def made(images, order="<", big=False, packing=1, predictor=1, tile=None, rows=None):
    """A file of the images; directories come after their data, chained."""
    word, count = ("Q", "Q") if big else ("I", "H")
    out = bytearray(({"<": b"II", ">": b"MM"}[order]) + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)))
    link = 8 if big else 4
    for image in images:
        h, w = image.shape
        th, tw = tile or (rows or h, w)
        places, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = image[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - len(part)), (0, tw - part.shape[1])))
                part = differences(part, predictor)
                raw = PACK[packing](part.astype(part.dtype.newbyteorder(order)).tobytes())
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        tags = [(256, 3, [w]), (257, 4, [h]), (258, 3, [image.itemsize * 8]), (259, 3, [packing]), (270, 2, None), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]])]
        tags += [(322, 3, [tw]), (323, 3, [th]), (324, 16 if big else 4, places), (325, 4, sizes)] if tile else [(273, 16 if big else 4, places), (278, 3, [th]), (279, 4, sizes)]
        fields = b""
        for tag, kind, values in sorted(tags):
            form = {2: "s", 3: "H", 4: "I", 16: "Q"}[kind]
            body = b"x\0" if values is None else struct.pack(f"{order}{len(values)}{form}", *values)
            room = struct.calcsize(word)
            if len(body) > room:
                where, body = len(out), out.extend(body) or b""
                body = struct.pack(order + word, where)
            fields += struct.pack(order + "HH" + word, tag, kind, 2 if values is None else len(values)) + body.ljust(room, b"\0")
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(tags)) + fields
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


def image_of(kind, h=37, w=29, seed=0):
    rng = np.random.default_rng(seed)
    out = np.add.outer(np.arange(h) * 3, np.arange(w)) + rng.integers(0, 5, (h, w))
    return (out - 20 if np.dtype(kind).kind != "u" else out).astype(kind)


@pytest.mark.parametrize("packing", sorted(PACK))
@pytest.mark.parametrize("layout", [{}, {"rows": 5}, {"tile": (16, 16)}])
def test_compressions_and_layouts(packing, layout):
    for kind, order, big in (("u1", "<", False), ("u2", ">", False), ("i2", "<", True), ("u4", ">", True), ("f4", "<", False), ("f8", ">", True)):
        image = image_of(kind)
        predictors = (1, 3) if kind[0] == "f" else (1, 2)
        for predictor in predictors:
            got = tiff.decode(made([image], order, big, packing, predictor, **layout))
            assert got.dtype.kind == image.dtype.kind and (got == image).all(), (kind, order, big, predictor)


def test_long_tables_of_codes():
    """More codes than a table holds."""
    image = np.random.default_rng(3).integers(0, 7, (300, 200)).astype("u2")
    assert (tiff.decode(made([image], packing=5)) == image).all()
    assert (tiff.decode(made([image * 0], packing=5)) == 0).all()


def test_pages():
    images = [image_of("u2", seed=k, h=10 + k) for k in range(4)]
    for big in (False, True):
        data = made(images, big=big)
        assert len(tiff.pages(data)) == 4 and all((tiff.decode(data, k) == i).all() for k, i in enumerate(images))
        with pytest.raises(RecordingError, match="no page 4"):
            tiff.decode(data, 4)


def test_round_trip():
    for kind in ("u1", "u2", "i4", "f4", "f8"):
        assert (tiff.decode(tiff.encode(image_of(kind))) == image_of(kind)).all()


def test_damaged_files():
    data = bytearray(made([image_of("u2")], packing=8))
    for bad, said in ((b"", "not a TIFF"), (b"II\x2a\0", "not a TIFF"), (b"GIF89a..", "not a TIFF"), (bytes(data[:4]) + struct.pack("<I", 1 << 30) + bytes(data[8:]), "chain")):
        with pytest.raises(RecordingError, match=said):
            tiff.decode(bad)
    plain = tiff.encode(image_of("u2"))
    with pytest.raises(RecordingError, match="cut off"):
        tiff.decode(plain[:-10])
    for tag, value, said in ((259, 7, "compression 7"), (277, 3, "grey"), (258, 12, "12 bits")):
        changed = bytearray(plain)
        at = 10 + 12 * next(i for i in range(10) if struct.unpack_from("<H", plain, 10 + 12 * i)[0] == tag)
        struct.pack_into("<I", changed, at + 8, value)
        with pytest.raises(RecordingError, match=said):
            tiff.decode(bytes(changed))
    # A chain that ends in itself.
    first = struct.unpack_from("<I", plain, 4)[0]
    loop = bytearray(plain)
    struct.pack_into("<I", loop, first + 2 + 12 * 10, first)
    with pytest.raises(RecordingError, match="chain"):
        tiff.decode(bytes(loop))
