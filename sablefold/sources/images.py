"""Images: intake checks, a PNG codec, masks and the page transform."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import scale
from ..runtime import ship

MAX_BYTES, LEAST_SIDE = 25 * 1024 * 1024, 1500
# Content types, the formats that each may hold, and the format that goes out.
FORMATS = {
    "image/png": (("PNG",), "PNG"),
    "image/jpeg": (("JPEG", "MPO"), "JPEG"),
    "image/jpg": (("JPEG", "MPO"), "JPEG"),
    "image/pjpeg": (("JPEG", "MPO"), "JPEG"),
    "image/webp": (("WEBP",), "WEBP"),
    "image/gif": (("GIF",), "PNG"),
    "image/bmp": (("BMP",), "PNG"),
    "image/x-ms-bmp": (("BMP",), "PNG"),
    "image/tiff": (("TIFF",), "PNG"),
    "image/tif": (("TIFF",), "PNG"),
    "image/heic": (("HEIF",), "JPEG"),
    "image/heif": (("HEIF",), "JPEG"),
    "image/avif": (("AVIF",), "WEBP"),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, content, length."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def sniffed(content: Column) -> Column:
    """The format that the first bytes tell."""
    head = F.hex(F.substring(content, 1, 12))
    brand = F.substring(head, 17, 8)
    heif = [b.encode().hex().upper() for b in ("heic", "heix", "mif1", "hevc")]
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("47494638"), "GIF").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF")
        .when(head.startswith("52494646") & (brand == b"WEBP".hex().upper()), "WEBP").when((F.substring(head, 9, 8) == b"ftyp".hex().upper()) & brand.isin(heif), "HEIF")
        .when((F.substring(head, 9, 8) == b"ftyp".hex().upper()) & (brand == b"avif".hex().upper()), "AVIF").when(head.startswith("424D") & (F.length(content) >= 26), "BMP")
    )


def ingest(images: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``images(content, mime_type)`` with format, output_format and error: size first, then type, then content."""
    allowed = F.create_map(*[x for m, (f, _) in FORMATS.items() for x in (F.lit(m), F.array(*map(F.lit, f)))])
    goes_out = F.create_map(*[x for m, (_, o) in FORMATS.items() for x in (F.lit(m), F.lit(o))])
    accepted = F.try_element_at(allowed, F.lower("mime_type"))
    error = (
        F.when(F.length("content") > max_bytes, "E_INPUT_TOO_LARGE").when(accepted.isNull(), "E_INPUT_FORMAT")
        .when(F.col("format").isNull() | ~F.array_contains(accepted, F.col("format")), "E_INPUT_FORMAT")
    )
    return images.withColumn("format", sniffed(F.col("content"))).withColumn("error", error).withColumn("output_format", F.when(F.col("error").isNull(), F.try_element_at(goes_out, F.lower("mime_type"))))


def page_transform(width: Column, height: Column) -> Column:
    """Input pixels to those that are read: small pages are enlarged until the long side has 1500, by whole pixels."""
    longest = F.greatest(width, height)
    factor = F.when(longest < LEAST_SIDE, F.lit(LEAST_SIDE) / longest).otherwise(F.lit(1.0))
    return scale(F.bround(width * factor, 0) / width, F.bround(height * factor, 0) / height)


def encode_png(pixels: np.ndarray) -> bytes:
    """RGB of 8 bits a channel; decoding gives the same pixels back."""
    h, w, _ = pixels.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * 3)]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (h, w, 3) of an 8-bit grey, RGB or RGBA image without interlacing; alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("this kind of PNG image isn't read")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind:
            line = _from_left(line.tolist(), above.tolist(), channels, kind == 4)
        out[y], above = line, line
    out = out.reshape(h, w, channels)
    return np.repeat(out, 3, axis=2) if channels == 1 else out[:, :, :3].copy()


def _from_left(line: list[int], above: list[int], channels: int, paeth: bool) -> np.ndarray:
    """A row that each byte's left neighbour helps to tell: by the mean with the byte above, or by the nearest of three."""
    left = [0] * channels + line
    corner = [0] * channels + above
    for i, (byte, b) in enumerate(zip(line, above)):
        a, c = left[i], corner[i]
        if paeth:
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            add = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        else:
            add = (a + b) >> 1
        left[i + channels] = (byte + add) & 255
    return np.array(left[channels:], np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels (h, w, 3), upright: PNG by ``decode_png``, other kinds where Pillow is installed."""
    try:
        return decode_png(data)
    except ValueError:
        try:
            from PIL import Image, ImageOps
        except ImportError:
            raise ValueError("only 8-bit PNG images are read without Pillow") from None
        with Image.open(BytesIO(data)) as image:
            return np.array(ImageOps.exif_transpose(image).convert("RGB"))


def encode(pixels: np.ndarray, kind: str) -> bytes:
    """PNG, or JPEG and WEBP where Pillow is installed; nothing but pixels goes out."""
    if kind == "PNG":
        return encode_png(pixels)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError(f"{kind} isn't written without Pillow") from None
    out = BytesIO()
    Image.fromarray(pixels).save(out, kind, quality=92)
    return out.getvalue()


def enlarged(pixels: np.ndarray) -> np.ndarray:
    """The page that is read: a long side of ``LEAST_SIDE`` at least, weighed between the nearest pixels."""
    h, w, _ = pixels.shape
    longest = max(h, w)
    if longest >= LEAST_SIDE:
        return pixels
    factor = LEAST_SIDE / longest
    high, wide = round(h * factor), round(w * factor)
    y, x = (np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1) for n, old in ((high, h), (wide, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float32)
    upper, lower = (p[r][:, x0] * (1 - fx) + p[r][:, x1] * fx for r in (y0, y1))
    return np.rint(upper * (1 - fy) + lower * fy).astype(np.uint8)


PAGES = "doc_id long, content binary, width int, height int, page binary, page_width int, page_height int, error string"


def pages(images: DataFrame) -> DataFrame:
    """``images(doc_id, content)`` -> ``PAGES``: the image's size, and the page that is read, as PNG.

    What can't be decoded has an error and no page.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PAGES.split(", ")]
        for b in batches:
            rows = []
            for doc_id, content in zip(b["doc_id"], b["content"]):
                try:
                    pixels = decode(bytes(content))
                    page = enlarged(pixels)
                    rows.append((doc_id, content, pixels.shape[1], pixels.shape[0], encode_png(page), page.shape[1], page.shape[0], None))
                except Exception as e:  # fail closed, and go on with the others
                    rows.append((doc_id, content, 0, 0, None, 0, 0, f"E_INPUT_FORMAT: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return images.select("doc_id", "content").mapInPandas(run, PAGES)


# Capitals and brackets, five wide and seven high, a row of five bits in each pair of digits.
GLYPHS = {
    c: [int(rows[i : i + 2], 16) for i in range(0, 14, 2)]
    for c, rows in zip(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]",
        "0E11111F111111 1E11111E11111E 0E11101010110E 1E11111111111E 1F10101E10101F 1F10101E101010 0E11101713110F 1111111F111111 0E04040404040E 0702020202120C 11121418141211 1010101010101F 111B1515111111 "
        "11191513111111 0E11111111110E 1E11111E101010 0E11111115120D 1E11111E141211 0F10100E01011E 1F040404040404 1111111111110E 11111111110A04 11111115151B11 11110A040A1111 11110A04040404 1F01020408101F 0E08080808080E 0E02020202020E".split(),
    )
}


def caption(pixels: np.ndarray, x: int, y: int, w: int, h: int, category: str, short: str, colour: tuple[int, int, int]) -> None:
    """Writes [CATEGORY] into the middle of a box, or its initials where that is too wide; what doesn't fit is left out."""
    k = max(1, min(max(int(h * 0.6), 10), 24) // 7)
    text = f"[{short}]"
    if len(text) * 6 * k > w - 4:
        text = f"[{''.join(c for c in category if c.isalpha())[:3]}]"
    height, width, _ = pixels.shape
    left, top = x + w // 2 - len(text) * 6 * k // 2, y + h // 2 - 7 * k // 2
    for n, c in enumerate(text):
        bits = np.array([[row >> (4 - i) & 1 for i in range(5)] for row in GLYPHS.get(c, [0] * 7)], bool)
        ys, xs = np.nonzero(np.kron(bits, np.ones((k, k), bool)))
        ys, xs = ys + top, xs + left + n * 6 * k
        on = (ys >= max(0, y)) & (ys < min(height, y + h)) & (xs >= max(0, x)) & (xs < min(width, x + w))
        pixels[ys[on], xs[on]] = colour


def mask(pixels: np.ndarray, x: int, y: int, w: int, h: int, style: str, colour: tuple[int, int, int], padding: int, cell: int) -> None:
    """Paints one box over, in place: one flat colour, for ``pixelate`` the box's mean."""
    height, width, _ = pixels.shape
    x0, y0 = max(0, x - padding), max(0, y - padding)
    x1, y1 = min(width, x + w + padding), min(height, y + h + padding)
    if x0 >= x1 or y0 >= y1:
        return
    area = pixels[y0:y1, x0:x1]
    area[:] = area.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (area.shape[0] * area.shape[1]) if style == "pixelate" else np.array(colour, np.uint8)
