"""Image bytes as pixels: decoding, resampling and normalising, in Arrow batches.

PNG (8 bits, not interlaced), binary PGM and PPM, and plain BMP are read with numpy
alone; other formats need a reader that the caller gives.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column

from .udf import batch_udf

#: Pixels of an image at most: what a worker unpacks for one row is bounded.
LIMIT = 1 << 26
#: Values of finished images that a worker holds before it sends them (a single image may have more).
HELD = 1 << 20
#: First bytes of formats, and samples of a pixel by a PNG's colour type (fixed values).
PNG, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: What :func:`decoded` and :func:`prepared` return.
PIXELS = "struct<width:int,height:int,channels:int,pixels:array<float>,error:string>"
SHAPE = "struct<width:int,height:int,channels:int,error:string>"


def _checked(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise ValueError("no pixels")
    if width * height > LIMIT:
        raise ValueError(f"more than {LIMIT} pixels")


def _unfiltered(data: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """PNG rows without their filters (none, left, above, mean of both, nearest of three)."""
    rows = data[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)  # a row of zeros stands above the first
    kinds = rows[:, 0]
    starts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == 1) | (kinds[1:] > 2)])
    for y, end in zip(starts.tolist(), [*starts[1:].tolist(), height], strict=True):  # rows alike in a run, where one doesn't need its neighbours
        kind, line, above = kinds[y], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1 : end + 1] = rows[y:end, 1:]
        elif kind == 1:
            out[y + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            out[y + 1 : end + 1] = np.cumsum(rows[y:end, 1:], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            now = [0] * step + line.tolist()
            up = [0] * step + above.tolist()
            for i in range(step, stride + step):
                a, b, c = now[i - step], up[i], up[i - step]
                if kind == 3:
                    near = (a + b) // 2
                else:
                    near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[i] = (now[i] + near) & 255
            out[y + 1] = now[step:]
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    at, chunks, palette = len(PNG), [], None
    head = None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("PNG is cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            chunks.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not chunks:
        raise ValueError("PNG without pixels")
    width, height, bits, colour, _, _, interlaced = head
    _checked(width, height)
    if bits != 8 or interlaced or colour not in SAMPLES:
        raise ValueError("PNG of another kind than 8 bits, not interlaced")
    step = SAMPLES[colour]
    size = height * (width * step + 1)
    flat = zlib.decompressobj().decompress(b"".join(chunks), size)
    if len(flat) < size:
        raise ValueError("PNG is cut off")
    image = _unfiltered(np.frombuffer(flat, np.uint8), height, width * step, step).reshape(height, width, step)
    if colour == 3:
        if palette is None or image.max() >= len(palette):
            raise ValueError("PNG without its palette")
        return palette[image[..., 0]]
    return image[..., : 3 if step > 2 else 1]


def read_netpbm(data: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words.append(int(data[at:end]))
        at = end
    width, height, top = words
    _checked(width, height)
    step = 3 if data[:2] == b"P6" else 1
    body = np.frombuffer(data, np.uint8, offset=at + 1) if at < len(data) else np.zeros(0, np.uint8)
    if top != 255 or len(body) < width * height * step:
        raise ValueError("netpbm image is cut off" if top == 255 else "netpbm image of other depth")
    return body[: width * height * step].reshape(height, width, step)


def read_bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    _checked(width, abs(height))
    if bits not in (24, 32) or packed:
        raise ValueError("BMP of another kind than plain 24 or 32 bits")
    line = (width * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, offset=min(start, len(data)))
    if len(body) < line * abs(height):
        raise ValueError("BMP is cut off")
    rows = body[: line * abs(height)].reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    return (rows[::-1] if height > 0 else rows)[..., 2::-1]


def decode(data: bytes, reader: Callable[[bytes], np.ndarray] | None = None) -> np.ndarray:
    """[height, width, 1 or 3] of bytes; alpha is dropped.  ValueError for what can't be read."""
    try:
        if data[:8] == PNG:
            return read_png(data)
        if data[:2] in (b"P5", b"P6"):
            return read_netpbm(data)
        if data[:2] == b"BM":
            return read_bmp(data)
        if reader:
            return np.atleast_3d(reader(data))
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("unknown image format")


def _shares(size: int, target: int) -> np.ndarray:
    """[target, size]: how much of each source cell lies in a target cell."""
    edge = np.arange(target + 1) * size / target
    cell = np.arange(size)
    inside = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    share = np.maximum(inside, 0)
    return share / share.sum(axis=1, keepdims=True)


def _between(size: int, target: int) -> np.ndarray:
    """[target, size]: weights of the two source cells next to a target cell's middle."""
    at = np.clip((np.arange(target) + 0.5) * size / target - 0.5, 0, size - 1)
    low = np.minimum(at.astype(int), size - 1)
    high = np.minimum(low + 1, size - 1)
    out = np.zeros((target, size))
    np.add.at(out, (np.arange(target), low), 1 - (at - low))
    np.add.at(out, (np.arange(target), high), at - low)
    return out


def resample(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each axis by area where it shrinks, linear between neighbours where it grows; halves round up."""
    if (height, width) == image.shape[:2]:
        return image
    weights = [(_shares if target < size else _between)(size, target) for size, target in zip(image.shape[:2], (height, width), strict=True)]
    rows = np.tensordot(weights[0], image.astype(float), axes=(1, 0))
    return np.floor(np.tensordot(weights[1], rows, axes=(1, 1)).transpose(1, 0, 2) + 0.5).clip(0, 255).astype(np.uint8)


def _framed(image: np.ndarray, width: int, height: int, pad: bool) -> np.ndarray:
    """Stretched to the target; or (``pad``) fitted into it, centred on black."""
    if not pad:
        return resample(image, width, height)
    scale = min(width / image.shape[1], height / image.shape[0])
    w, h = max(1, int(image.shape[1] * scale)), max(1, int(image.shape[0] * scale))
    out = np.zeros((height, width, image.shape[2]), np.uint8)
    y, x = (height - h) // 2, (width - w) // 2
    out[y : y + h, x : x + w] = resample(image, w, h)
    return out


def _rows(values: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(values, columns=["width", "height", "channels", "pixels", "error"], dtype=object)


def _each(read: Callable, *columns: pd.Series) -> Iterator[pd.DataFrame]:
    """Results in parts that end with the image that fills HELD."""
    out, held = [], 0
    for row in zip(*columns, strict=True):
        try:
            if row[0] is None:
                raise ValueError("no image")
            image, values = read(*row)
            out.append((image.shape[1], image.shape[0], image.shape[2], values, None))
            held += values.size
        except ValueError as e:
            out.append((None, None, None, None, str(e)))
        if held >= HELD:
            yield _rows(out)
            out, held = [], 0
    if out:
        yield _rows(out)


def decoded(data: Column, reader: Callable | None = None) -> Column:
    """Size, channels and pixels (row by row, channels together) of image bytes.

    What can't be read, null included, gives an error instead and fails no query.
    """

    @batch_udf(PIXELS)
    def run(b: pd.Series) -> Iterator[pd.DataFrame]:
        return _each(lambda x: ((i := decode(bytes(x), reader)), i.ravel().astype(np.float32)), b)

    return run(data)


def prepared(data: Column, width: Column, height: Column, pad: bool = True, unit: bool = True, rgb: bool = True, reader: Callable | None = None) -> Column:
    """Decoded, made RGB, resized and scaled to [0, 1], each as asked: what a model takes.

    The result has width * height * channels floats for every readable image.
    """

    @batch_udf(PIXELS)
    def run(b: pd.Series, w: pd.Series, h: pd.Series) -> Iterator[pd.DataFrame]:
        def one(x, width, height) -> tuple:
            if pd.isna(width) or pd.isna(height):
                raise ValueError("no target size")
            _checked(int(width), int(height))
            image = _framed(decode(bytes(x), reader), int(width), int(height), pad)
            image = np.repeat(image, 3, axis=2) if rgb and image.shape[2] == 1 else image
            values = image.ravel().astype(np.float32)
            return image, values / np.float32(255) if unit else values

        return _each(one, b, w, h)

    return run(data, width, height)


def write_png(image: np.ndarray) -> bytes:
    """An image [height, width, 1 or 3] of bytes as PNG, each row filtered by the one above."""
    height, width, step = image.shape
    rows = image.reshape(height, width * step)
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), rows - np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if step == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


@batch_udf("binary")
def as_png(data: pd.Series) -> pd.Series:
    """Readable images as PNG, others null."""

    def one(x) -> bytes | None:
        try:
            return write_png(decode(bytes(x)))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(x) for x in data], dtype=object)
