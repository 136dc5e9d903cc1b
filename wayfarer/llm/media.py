"""Media columns: PNG images in binary columns, checked chunk by chunk, unfiltered with numpy and hashed by their low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfarer.llm.common import bounded, utf8, values

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
IDAT_BYTES = 1 << 16


class PngError(ValueError):
    """Bytes that are no whole 8-bit grayscale PNG."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grayscale PNG of a (height, width) array; rows with less residual energy are stored by the Up filter, the others as they are."""
    height, width = samples.shape
    up = samples.copy()
    up[1:] -= samples[:-1]
    rows = np.empty((height, width + 1), np.uint8)
    cost = lambda a: np.minimum(a, np.uint8(0) - a).sum(axis=1, dtype=np.int64)
    use_up = cost(up) * 4 < cost(samples)
    rows[:, 0] = use_up * 2
    rows[:, 1:] = np.where(use_up[:, None], up, samples)
    packer = zlib.compressobj(level)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    packed = packer.compress(rows.tobytes()) + packer.flush()
    out += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def chunks(data: bytes):
    """(kind, body) of each chunk; raises PngError for a bad signature, a cut chunk or a wrong checksum."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, kind = 8, b""
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            raise PngError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise PngError(f"checksum of chunk {kind!r} differs")
        yield kind, body
        at += 12 + n
    if kind != b"IEND":
        raise PngError("no end chunk")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered scanlines (height, 1 + width), one byte a pixel. Runs of None rows and of Up rows go through numpy at once."""
    kinds, x = rows[:, 0], rows[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip([0, *edges], [*edges, len(kinds)], strict=True):
        if first == last:
            continue
        kind = kinds[first]
        if kind == 0:
            continue
        if kind == 1:
            x[first:last] = np.cumsum(x[first:last], axis=1, dtype=np.uint8)
        elif kind == 2:
            if first:
                x[first] += x[first - 1]
            x[first:last] = np.cumsum(x[first:last], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(first, last):
                above = x[y - 1].astype(int).tolist() if y else [0] * x.shape[1]
                row, left, corner = x[y].tolist(), 0, 0
                for k, up in enumerate(above):
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                        guess = left if a <= b and a <= c else up if b <= c else corner
                    left, corner = (row[k] + guess) & 255, up
                    row[k] = left
                x[y] = row
        else:
            raise PngError(f"filter {kind} is unknown")
    return x


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of an 8-bit grayscale PNG without interlace."""
    width = height = 0
    packed = []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise PngError("only 8-bit grayscale without interlace is read")
        elif kind == b"IDAT":
            packed.append(body)
    raw = zlib.decompress(b"".join(packed))
    if not width or len(raw) != height * (width + 1):
        raise PngError("the samples do not fill the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _basis(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(k)[:, None])


_COS = _basis(32, 8)


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n nearly equal bands along axis 0 (rows repeat where there are fewer than n)."""
    ends = np.arange(n + 1) * a.shape[0] // n
    starts = np.minimum(ends[:-1], a.shape[0] - 1)
    counts = np.maximum(ends[1:] - starts, 1)
    sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)])
    return (sums[starts + counts] - sums[starts]) / counts.reshape(-1, *[1] * (a.ndim - 1))


def cosine_hash(samples: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest cosine frequencies of the image shrunk to 32 x 32, each against their median (the constant term left out of it)."""
    columns = samples.reshape(samples.shape[0], 32, -1).mean(axis=2) if samples.shape[1] % 32 == 0 else _shrink(samples.T, 32).T
    low = np.round(_COS @ _shrink(columns, 32) @ _COS.T, 6).ravel()
    return int("".join("1" if v > np.median(low[1:]) else "0" for v in low), 2)


def _per_row(df: DataFrame, columns: list[str], schema: str, kinds, row) -> DataFrame:
    """A row of ``schema`` for each row of ``columns``: doc_id, then values that ``row`` makes the others of."""
    bounded(df)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [row(*x) for x in zip(*(values(c) for c in batch.columns[1:]), strict=True)]
            made = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names)

    return df.select(*columns).mapInArrow(run, schema)


def text_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, a binary column: each text as a 192-wide PNG.

    The text's UTF-8 is filled up with spaces to a positive multiple of 192; null and empty texts give one row of spaces.
    Equal texts give equal images; other columns of ``docs`` are ignored; one row per input row.
    """

    def row(raw):
        size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
        return len(raw), encode_png(np.frombuffer(raw.ljust(size), np.uint8).reshape(-1, WIDTH))

    df = docs.select("doc_id", utf8().alias("text"))
    return _per_row(df, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", [pa.int64(), pa.binary()], row)


def read_back(images: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of ``images`` with digests and a hash of what their stored bytes hold.

    The image is decoded from the binary column (signature, every chunk checksum, inflate, unfilter) and all digests are of
    those bytes: payload_bytes, payload_sha256, tail_crc32 (last 16), media_bytes, media_sha256, feature. A null image, or
    one that is no whole PNG, fails.
    """

    def row(n, media):
        image = decode_png(media)
        payload = image.tobytes()
        return n, media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{cosine_hash(image):016x}"

    schema = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _per_row(images, ["doc_id", "n_bytes", "media"], schema, [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], row)
