"""Binary map layers: elevation rasters, feature lists and vector tiles, read with ``binaryFile`` in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A raster is five int32 (zoom, first pixel x and y, width, height), two float64 (origin), int16 heights, little-endian; the phone's has a version byte of 1 before.
HEADER = struct.Struct("<5i2d")


def encode_raster(z: int, px0: int, py0: int, heights: np.ndarray, lat: float, lon: float, version: bool = False) -> bytes:
    rows, cols = heights.shape
    return (b"\x01" if version else b"") + HEADER.pack(z, px0, py0, cols, rows, lat, lon) + heights.astype("<i2").tobytes()


def decode_raster(data: bytes) -> tuple[tuple, np.ndarray]:
    """Header and heights; which of the two forms it is follows from the length."""
    for skip in (0, 1):
        if len(data) >= skip + HEADER.size:
            head = HEADER.unpack_from(data, skip)
            n = head[3] * head[4]
            if n >= 0 and len(data) == skip + HEADER.size + 2 * n:
                return head, np.frombuffer(data, "<i2", n, skip + HEADER.size).reshape(head[4], head[3])
    raise ValueError("not an elevation raster")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, gx, gy, h): a row for each cell of every raster file under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                (_, px0, py0, cols, rows, _, _), h = decode_raster(bytes(data))
                gy, gx = np.divmod(np.arange(cols * rows), max(cols, 1))
                yield pd.DataFrame({"path": p, "gx": (px0 + gx).astype("int32"), "gy": (py0 + gy).astype("int32"), "h": h.ravel().astype("int16")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, gx int, gy int, h smallint")


def encode_features(features: list[tuple[int, bool, str | None, list[tuple[float, float]]]]) -> bytes:
    """A version byte, a count, then kind, area flag, optional name and float32 points of each."""
    out = [b"\x01", struct.pack("<i", len(features))]
    for kind, area, name, points in features:
        raw = b"" if name is None else name.encode()
        out.append(struct.pack("<BBB", kind, area, name is not None) + (struct.pack("<i", len(raw)) + raw if name is not None else b"") + struct.pack("<i", len(points)))
        out.append(np.asarray(points, "<f4").tobytes())
    return b"".join(out)


def decode_features(data: bytes) -> list[tuple[int, bool, str | None, list[tuple[float, float]]]]:
    at, out = 5, []
    for _ in range(struct.unpack_from("<i", data, 1)[0]):
        kind, area, named = struct.unpack_from("<BBB", data, at)
        at += 3
        name = None
        if named:
            n = struct.unpack_from("<i", data, at)[0]
            name = data[at + 4 : at + 4 + n].decode()
            at += 4 + n
        n = struct.unpack_from("<i", data, at)[0]
        pts = np.frombuffer(data, "<f4", 2 * n, at + 4).reshape(n, 2)
        at += 4 + 8 * n
        out.append((kind, bool(area), name, [tuple(map(float, p)) for p in pts]))
    return out


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned protocol-buffer varint and where the next field begins."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; fixed-width values stay bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, at = data[at : at + n], at + n
        yield number, value


def geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Rings and lines of a vector tile's command integers."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            out[-1].append(out[-1][0])
            continue
        for _ in range(times):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            if what == 1:
                out.append([(x, y)])
            else:
                out[-1].append((x, y))
    return out


def _value(data: bytes):
    for number, v in fields(data):
        if number == 1:
            return v.decode()
        if number == 2:
            return struct.unpack("<f", v)[0]
        if number == 3:
            return struct.unpack("<d", v)[0]
        if number == 6:
            return (v >> 1) ^ -(v & 1)
        return bool(v) if number == 7 else v
    return None


def decode_tile(data: bytes) -> list[tuple[str, int, dict, list[list[tuple[int, int]]]]]:
    """(layer, geometry type, properties, lines) of every feature of a vector tile."""
    out = []
    for number, layer in fields(data):
        if number != 3:
            continue
        parts: dict[int, list] = {}
        for n, v in fields(layer):
            parts.setdefault(n, []).append(v)
        keys, values = [k.decode() for k in parts.get(3, [])], [_value(v) for v in parts.get(4, [])]
        for f in parts.get(2, []):
            kind, tags, shape = 0, [], []
            for n, v in fields(f):
                if n == 3:
                    kind = v
                elif n in (2, 4):
                    at, listed = 0, []
                    while at < len(v):
                        x, at = varint(v, at)
                        listed.append(x)
                    tags, shape = (listed, shape) if n == 2 else (tags, listed)
            out.append((parts[1][0].decode(), kind, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, geometry(shape)))
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of an 8-bit grey, RGB or RGBA image that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    wide, high, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("a kind of PNG that is not read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(high, 1 + wide * channels)
    out = np.zeros((high + 1, wide + 1, channels), np.uint8)
    for y, line in enumerate(lines, 1):
        raw = line[1:].reshape(wide, channels)
        if line[0] == 0:
            out[y, 1:] = raw
        elif line[0] == 1:  # each pixel is a difference from the one before
            out[y, 1:] = np.cumsum(raw, axis=0, dtype=np.uint64).astype(np.uint8)
        elif line[0] == 2:
            out[y, 1:] = raw + out[y - 1, 1:]
        else:
            for x in range(1, wide + 1):
                left, up, corner = (v.astype(int) for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]))
                if line[0] == 3:
                    guess = (left + up) // 2
                else:  # Paeth: the neighbour nearest to their plane
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y, x] = raw[x - 1] + guess.astype(np.uint8)
    return out[1:, 1:]


def read_elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile_x, tile_y, cx, cy, h) of elevation tiles stored as .../x/y.png, in whole metres."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def rows(batches):
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rgb = decode_png(body)[:, :, :3].astype(float)
                h = np.clip(np.round(rgb[:, :, 0] * 256 + rgb[:, :, 1] + rgb[:, :, 2] / 256 - 32768), -32768, 32767).astype(np.int16)
                x, y = (int(p) for p in name.removesuffix(".png").split("/")[-2:])
                cy, cx = np.indices(h.shape)
                n = h.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int64)), pa.array(np.full(n, y, np.int64)), pa.array(cx.ravel().astype(np.int32)), pa.array(cy.ravel().astype(np.int32)), pa.array(h.ravel())], ["tile_x", "tile_y", "cx", "cy", "h"])

    return files.mapInArrow(rows, "tile_x long, tile_y long, cx int, cy int, h short")
