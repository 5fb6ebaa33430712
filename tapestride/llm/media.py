"""TIFF in plain Python and NumPy: files of 8-bit samples, their directories and their pages.

The reader walks the chain of image directories, decodes strips or tiles (stored plain, as
PackBits, LZW or deflate), undoes the horizontal predictor and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, lean, slices

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH = 64


class TiffError(ValueError):
    """The bytes are no TIFF file, or of a kind that is not read here."""


_BROKEN = (TiffError, struct.error, zlib.error, IndexError, KeyError, ValueError, ZeroDivisionError)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widened one code early as TIFF has it."""
    acc, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table, width, nxt, prefix = {bytes((i,)): i for i in range(256)}, 9, 258, b""
    put(256, 9)
    for b in data:
        longer = prefix + bytes((b,))
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = nxt
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
        if nxt >= 4094:
            put(256, width)
            table, width, nxt = {bytes((i,)): i for i in range(256)}, 9, 258
        prefix = bytes((b,))
    if prefix:
        put(table[prefix], width)
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, prev, out = list(base), 9, None, []
    acc = bits = 0
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif prev is not None and code == len(table):
            entry = prev + prev[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        if prev is not None:
            table.append(prev + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        prev = entry
    return b"".join(out)


_PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}


def write(pages: list[bytes], width: int = WIDTH, compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: int = 0) -> bytes:
    """A little-endian TIFF file with a grey page for each payload, whose length is a multiple of ``width``.

    ``tile`` (a multiple of 16) stores square tiles instead of strips, padded with zeros.
    """
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for data in pages:
        image = np.frombuffer(data, np.uint8).reshape(-1, width)
        if tile:
            high, wide = -(-image.shape[0] // tile), -(-width // tile)
            full = np.zeros((high * tile, wide * tile), np.uint8)
            full[: image.shape[0], :width] = image
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(high) for x in range(wide)]
        else:
            parts = [image[y : y + rows_per_strip] for y in range(0, image.shape[0], rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
            stored = _PACK[compression](part.tobytes())
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored + b"\0" * (len(stored) % 2)
        tags = [(256, 4, [width]), (257, 4, [image.shape[0]]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows_per_strip]), (279, 4, counts)]
        at = {}
        for tag, kind, values in tags:
            if len(values) * _SIZES[kind] > 4:
                at[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, kind, values in sorted(tags):
            out += struct.pack("<HHI", tag, kind, len(values))
            out += struct.pack("<I", at[tag]) if tag in at else struct.pack("<I" if kind == 4 else "<HH", *values, *([0] if kind == 3 else []))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _values(data: bytes, order: str, kind: int, count: int, at: int) -> list[int]:
    if kind not in (1, 3, 4):
        return []
    size = _SIZES[kind] * count
    start = at if size <= 4 else struct.unpack_from(order + "I", data, at)[0]
    if start + size > len(data):
        raise TiffError("a value lies outside the file")
    return list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, start))


def read(data: bytes) -> list[dict]:
    """Every page as width, height, samples per pixel, compression, predictor and decoded bytes."""
    pages = read_each(data)
    for page in pages:
        if "error" in page:
            raise TiffError(page["error"])
    return pages


def read_each(data: bytes) -> list[dict]:
    """As ``read``, but a page that can't be decoded is its number and ``error``, and a broken chain of
    directories ends the list with an ``error`` without number."""
    out = []
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("no TIFF header")
        at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            (link,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
            try:
                tags = {}
                for i in range(n):
                    tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                    tags[tag] = _values(data, order, kind, count, at + 10 + 12 * i)
                out.append({"page": len(out), **_page(data, tags)})
            except _BROKEN as e:
                out.append({"page": len(out), "error": str(e) or type(e).__name__})
            at = link
    except _BROKEN as e:
        out.append({"error": str(e)})
    return out


def _page(data: bytes, tags: dict[int, list[int]]) -> dict:
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    width, height, spp, how, predictor = tags[256][0], tags[257][0], one(277, 1), one(259, 1), one(317, 1)
    if set(tags.get(258, [1])) != {8} or one(284, 1) != 1 or predictor not in (1, 2):
        raise TiffError("only interleaved 8-bit samples are read")
    unpack = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, 32946: zlib.decompress, PACKBITS: packbits_decode}
    if how not in unpack:
        raise TiffError(f"compression {how} is not read")

    def part(k: int, offset: int, count: int, rows: int, columns: int) -> np.ndarray:
        raw = np.frombuffer(unpack[how](data[offset : offset + count]), np.uint8)
        need = rows * columns * spp
        if raw.size < need:
            raise TiffError(f"part {k} is short")
        cube = raw[:need].reshape(rows, columns, spp)
        return np.cumsum(cube, 1, dtype=np.uint8) if predictor == 2 else cube

    if 324 in tags:
        tw, tl = tags[322][0], tags[323][0]
        wide, high = -(-width // tw), -(-height // tl)
        image = np.zeros((high * tl, wide * tw, spp), np.uint8)
        for k, (o, c) in enumerate(zip(tags[324], tags[325])):
            y, x = k // wide * tl, k % wide * tw
            image[y : y + tl, x : x + tw] = part(k, o, c, tl, tw)
        image = image[:height, :width]
    else:
        rows = min(one(278, height), height) or 1
        parts = [part(k, o, c, min(rows, height - k * rows), width) for k, (o, c) in enumerate(zip(tags[273], tags[279]))]
        image = np.concatenate(parts) if parts else np.zeros((0, width, spp), np.uint8)
    if image.shape[0] != height:
        raise TiffError("strips are missing")
    return {"width": width, "height": height, "samples": spp, "compression": how, "predictor": predictor, "pixels": image.tobytes()}


def decode_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of every TIFF: its number, shape, storage and decoded ``pixels``.

    A null, empty or unreadable file gives one row with page null and ``error`` saying why, a page
    that can't be decoded one with its number and ``error``; so no input row and no page is lost. Only the two named columns are read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches):
        for whole in batches:
            for batch in slices(iter([whole]), "__media"):
                who, rows = [], []
                for i, data in enumerate(batch.column(1).to_pylist()):
                    found = read_each(data or b"") or [{"error": "no pages"}]
                    who += [i] * len(found)
                    rows += found
                columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *columns], [id_col, *schema.names])

    out = f"`{id_col}` {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
    return df.select(F.col(id_col), F.col(media_col).alias("__media")).mapInArrow(lean(run), out)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """One row per text with its TIFF file ``media``: UTF-8 bytes, then zeros up to a positive multiple of 64."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "__text"):
            files = [write([padded(x)], compression=compression, predictor=predictor) for x in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], [id_col, "media"])

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind}, media binary")


def padded(data: bytes) -> bytes:
    return data + b"\0" * ((-len(data)) % 64 or (64 if not data else 0))


def feature(page: dict) -> str:
    """Shape, mean, spread and entropy in bits of a page's samples."""
    counts = np.bincount(np.frombuffer(page["pixels"], np.uint8), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    levels = np.arange(256.0)
    mean = float(share @ levels)
    some = share[share > 0]
    return f"{page['width']}x{page['height']};mean={mean:.4f};sd={float(share @ (levels - mean) ** 2) ** 0.5:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"


def digests(df: DataFrame) -> DataFrame:
    """Stores each whole text as a TIFF file, reads the file back and describes what was read."""

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for x in encoded(batch.column(1)):
                media = write([padded(x)])
                page = read(media)[0]
                got = page["pixels"]
                rows.append((len(x), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(page)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names)

    return df.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
