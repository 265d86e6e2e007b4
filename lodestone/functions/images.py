"""Image inspection as pandas UDFs over encoded bytes."""

import importlib.util
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The channel means and deviations of the network's input.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _png(data: bytes) -> np.ndarray:
    """An 8-bit PNG that is not interlaced, as (height, width, channels)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    packed, head = [], None
    for kind, body in _png_parts(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * c)
    if not raw[:, 0].any():  # no line depends on another
        return raw[:, 1:].reshape(h, w, c)
    out = np.zeros((h, w * c), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * c, np.int64)
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + up
        else:
            row = np.zeros(w * c, np.int64)
            for x in range(w * c):
                left, corner = (row[x - c], up[x - c]) if x >= c else (0, 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                row[x] = (line[x] + guess) & 255
        out[y] = row & 255
    return out.reshape(h, w, c)


def _has_tags(tiff: bytes) -> bool:
    """Whether a TIFF block (what EXIF is) has any tag in its first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return False
    at = struct.unpack(order + "I", tiff[4:8])[0]
    return len(tiff) >= at + 2 and struct.unpack(order + "H", tiff[at : at + 2])[0] > 0


def _jpeg_parts(data: bytes):
    """(marker, body) of a JPEG file's segments before its first scan; an error if it is cut off."""
    at = 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":  # fill bytes
            at += 1
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise ValueError("no segment where one should be")
        kind = data[at + 1]
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xD9 or n < 2 or at + 2 + n > len(data):
            raise ValueError("cut off")
        yield kind, data[at + 4 : at + 2 + n]
        if kind == 0xDA:
            if data.find(b"\xff\xd9", at) < 0:
                raise ValueError("no end")
            return
        at += 2 + n


def _jpeg_info(data: bytes) -> tuple[int, int, bool]:
    size, exif = None, False
    for kind, body in _jpeg_parts(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            size = size or (width, height)
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            exif = exif or _has_tags(body[6:])
    return (*size, exif)


def _png_parts(data: bytes):
    """(kind, body) of a PNG file's chunks, whose checksums must hold; an error if it is cut off."""
    at, kind = 8, b""
    while kind != b"IEND":
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, end = data[at + 8 : at + 8 + n], at + 8 + n
        if len(data) < end + 4 or zlib.crc32(kind + body) != struct.unpack(">I", data[end : end + 4])[0]:
            raise ValueError("cut off or broken")
        yield kind, body
        at = end + 4


def _png_info(data: bytes) -> tuple[int, int, bool]:
    size, exif = None, False
    for kind, body in _png_parts(data):
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"eXIf":
            exif = exif or _has_tags(body)
    return (*size, exif)


def _webp_info(data: bytes) -> tuple[int, int, bool]:
    """From the RIFF chunks: the canvas of an extended file, else the size in the picture's own head."""
    size, exif, pictures = None, False, 0
    end = 8 + struct.unpack("<I", data[4:8])[0]
    if data[8:12] != b"WEBP" or len(data) < end:
        raise ValueError("cut off")
    at = 12
    while at + 8 <= end:
        kind, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("cut off")
        if kind == b"VP8X":
            size = tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif kind == b"VP8 ":
            if body[3:6] != b"\x9d\x01\x2a":
                raise ValueError("no key frame")
            size, pictures = size or tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10])), pictures + 1
        elif kind == b"VP8L":
            if body[:1] != b"\x2f":
                raise ValueError("no lossless head")
            bits = int.from_bytes(body[1:5], "little")
            size, pictures = size or (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)), pictures + 1
        elif kind == b"ANMF":
            pictures += 1
        elif kind == b"EXIF":
            exif = exif or _has_tags(body[6:] if body[:6] == b"Exif\0\0" else body)
        at += 8 + n + n % 2
    if not pictures:
        raise ValueError("no picture")
    return (*size, exif)


def container(data: bytes | None) -> tuple[int, int, bool] | None:
    """(width, height, has EXIF) by walking a JPEG, PNG or WebP file's parts, wherever they lie.

    Pixels are not decoded.  None where the parts are not whole, or the format is another.
    """
    kinds = ((b"\xff\xd8", _jpeg_info), (b"\x89PNG\r\n\x1a\n", _png_info), (b"RIFF", _webp_info))
    read = next((f for start, f in kinds if data and data.startswith(start)), None)
    try:
        found = read(data) if read else None
    except (ValueError, TypeError, struct.error):
        return None
    return found if found and min(found[:2]) > 0 else None


#: How files of the formats begin that Pillow reads and this module does not.
_OTHER_FORMATS = {b"\xff\xd8\xff": "JPEG", b"RIFF": "WebP", b"GIF8": "GIF", b"BM": "BMP"}


@cache
def _has_pillow() -> bool:
    """Asked once a worker: Python searches its whole path anew for a module that is not there."""
    return importlib.util.find_spec("PIL") is not None


class Unsupported(RuntimeError):
    """The bytes may be a whole image, but nothing here can decode its format."""


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """(pixels as RGB, has EXIF).  Pillow reads any format where it is installed; else PNG only,
    and other formats are an error that says so: they are not corrupt.
    (``readers.decoded_images`` decodes JPEG files in the JVM instead.)"""
    if not _has_pillow():
        for start, name in _OTHER_FORMATS.items():
            if data.startswith(start):
                raise Unsupported(f"{name} needs Pillow")
        pixels = _png(data)
        if pixels.shape[2] < 3:
            pixels = np.repeat(pixels[:, :, :1], 3, axis=2)
        return pixels[:, :, :3], container(data)[2]
    import io

    from PIL import Image

    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("RGB")), bool(image.getexif())


def _decoded(data: bytes | None):
    """As ``decode``, or None where the bytes are no whole image of a format that can be read."""
    if not data:
        return None
    try:
        return decode(data)
    except Unsupported:
        raise
    except Exception:  # noqa: BLE001  any error of the format's own decoder means the image is corrupt
        return None


def from_struct(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels of Spark's image struct, whose bytes are rows of blue, green, red (and alpha)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((2.5 - 0.5 * x) * x - 4) * x + 2, 0.0))


#: Kernels and how far they reach.
TRIANGLE, CUBIC = (_triangle, 1.0), (_cubic, 2.0)
#: Weights are rounded to so many binary digits.
_DIGITS = 22


def _weights(length: int, out: int, kernel, low: float, high: float) -> np.ndarray:
    """(out, length): what each sample of the range low to high weighs in each output sample.

    When shrinking, the kernel is stretched by the factor, so that every sample counts.
    """
    shape, reach = kernel
    scale = (high - low) / out
    stretch = max(scale, 1.0)
    centre = low + (np.arange(out) + 0.5) * scale
    first = np.maximum((centre - reach * stretch + 0.5).astype(int), 0)
    last = np.minimum((centre + reach * stretch + 0.5).astype(int), length)
    at = np.arange(length)[None]
    w = shape((at + 0.5 - centre[:, None]) / stretch) * ((at >= first[:, None]) & (at < last[:, None]))
    w = w / w.sum(axis=1, keepdims=True) * (1 << _DIGITS)
    return np.trunc(w + np.copysign(0.5, w))


#: Weights of few entries are kept, so that pictures of a size share them.
_SMALL = 1 << 12
_kept_weights = lru_cache(1024)(_weights)


def _weights_of(length: int, out: int, kernel, low: float, high: float) -> np.ndarray:
    return (_kept_weights if length * out <= _SMALL else _weights)(length, out, kernel, low, high)


def _pass(pixels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums down the first axis, rounded to 8 bits.  Sums of integers below 2^53 are exact."""
    flat = weights @ pixels.reshape(len(pixels), -1).astype(np.float64)
    rounded = np.floor((flat + (1 << (_DIGITS - 1))) / (1 << _DIGITS))
    return np.clip(rounded, 0, 255).astype(np.uint8).reshape(len(weights), *pixels.shape[1:])


def resample(pixels: np.ndarray, height: int, width: int, kernel=TRIANGLE, box: tuple[float, float] | None = None) -> np.ndarray:
    """8-bit pixels at another size: along rows, then along columns, with 8-bit pixels in between.

    ``box`` (height, width) is the part from the upper left corner that is taken, by default all;
    an axis that keeps its length is left alone.
    """
    h, w = pixels.shape[:2]
    high, wide = box or (h, w)
    if (width, wide) != (w, w):
        pixels = _pass(pixels.swapaxes(0, 1), _weights_of(w, width, kernel, 0.0, wide)).swapaxes(0, 1)
    if (height, high) != (h, h):
        pixels = _pass(pixels, _weights_of(h, height, kernel, 0.0, high))
    return pixels


def _block_means(pixels: np.ndarray, fy: int, fx: int) -> np.ndarray:
    """8-bit means of blocks; those at the lower and right edges may be smaller."""
    rows, columns = (np.arange(0, n, f) for n, f in zip(pixels.shape, (fy, fx)))
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, axis=0), columns, axis=1)
    n = np.minimum(fy, pixels.shape[0] - rows)[:, None] * np.minimum(fx, pixels.shape[1] - columns)[None]
    return ((sums + n // 2) * ((1 << 24) // n) >> 24).astype(np.uint8)


def thumbnail(grey: np.ndarray, longest: int = 512) -> np.ndarray:
    """A grey picture at most ``longest`` wide and high, by cubic resampling; smaller ones stay.

    A picture of more than twice the size is first brought near it by means of blocks.
    """
    h, w = grey.shape
    if max(h, w) <= longest:
        return grey
    aspect = w / h

    def nearest(x: float, off) -> int:
        return max(min(int(np.floor(x)), int(np.ceil(x)), key=off), 1)

    if aspect <= 1:
        height, width = longest, nearest(longest * aspect, lambda n: abs(aspect - n / longest))
    else:
        width, height = longest, nearest(longest / aspect, lambda n: abs(aspect - longest / n) if n else 0)
    fy, fx = (max(int(a / b / 2.0), 1) for a, b in ((h, height), (w, width)))
    if fy > 1 or fx > 1:
        return resample(_block_means(grey, fy, fx), height, width, CUBIC, (h / fy, w / fx))
    return resample(grey, height, width, CUBIC)


def grey_levels(pixels: np.ndarray) -> np.ndarray:
    """RGB as 8-bit grey, with the weights 0.299, 0.587 and 0.114 as 16-bit integers."""
    return ((pixels.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def blur(pixels: np.ndarray, longest: int = 512) -> float | None:
    """The population variance of the 4-neighbour Laplacian of the grey picture, at most 512 wide."""
    grey = thumbnail(grey_levels(pixels), longest).astype(np.float64)
    if min(grey.shape) < 3:
        return None
    lap = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * grey[1:-1, 1:-1]
    return float(np.var(lap))


@F.pandas_udf(T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("has_exif", T.BooleanType()))
def container_info(content: pd.Series) -> pd.DataFrame:
    """Size and EXIF flag by the file's parts, without decoding (see ``container``)."""
    rows = [container(data) or (None, None, None) for data in content]
    return pd.DataFrame(rows, columns=["width", "height", "has_exif"]).astype({"width": "Int32", "height": "Int32", "has_exif": "boolean"})


@F.pandas_udf(T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("has_exif", T.BooleanType()))
def inspect_image(content: pd.Series) -> pd.DataFrame:
    """Size and EXIF flag; nulls where the bytes cannot be decoded (see ``curate.image_status``).

    Without Pillow, JPEG and WebP files count by their parts; ``readers.inspected_images`` decodes
    the former in the JVM.
    """
    rows = []
    for data in content:
        try:
            found = _decoded(data)
        except Unsupported:
            if not data.startswith((b"\xff\xd8", b"RIFF")):
                raise
            rows.append(container(data) or (None, None, None))
            continue
        rows.append(_size(found))
    return pd.DataFrame(rows, columns=["width", "height", "has_exif"]).astype({"width": "Int32", "height": "Int32", "has_exif": "boolean"})


def _size(found) -> tuple:
    return (None, None, None) if found is None else (found[0].shape[1], found[0].shape[0], found[1])


def measured(size: int = 380):
    """A UDF from bytes to all of ``inspect_image``, ``blur_score`` (``blur``) and ``preprocess`` (``x``)
    as a struct: pixels are decoded once.  A format that only its parts tell of is an error here."""
    fields = T.StructType().add("width", T.IntegerType()).add("height", T.IntegerType()).add("has_exif", T.BooleanType())

    @F.pandas_udf(fields.add("blur", T.DoubleType()).add("x", T.ArrayType(T.FloatType())))
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            found = _decoded(data)
            rows.append((*_size(found), None if found is None else blur(found[0]), _network_input(found and found[0], size)))
        return pd.DataFrame(rows, columns=["width", "height", "has_exif", "blur", "x"]).astype({"width": "Int32", "height": "Int32", "has_exif": "boolean", "blur": "float64"})

    return run


def _pixels(row) -> np.ndarray:
    return from_struct(int(row["height"]), int(row["width"]), int(row["nChannels"]), row["data"])


@F.pandas_udf(T.DoubleType())
def blur_score(content: pd.Series) -> pd.Series:
    """Sharpness of encoded images; null where there is none or it cannot be decoded."""
    found = [_decoded(data) for data in content]
    return pd.Series([None if x is None else blur(x[0]) for x in found], dtype="float64")


@F.pandas_udf(T.DoubleType())
def blur_pixels(image: pd.DataFrame) -> pd.Series:
    """Sharpness of Spark's image structs (``readers.decoded_images``)."""
    return pd.Series([None if not r["data"] else blur(_pixels(r)) for r in image.to_dict("records")], dtype="float64")


def _network_input(pixels: np.ndarray | None, size: int):
    if pixels is None:
        return None
    x = resample(pixels, size, size).astype(np.float32) / np.float32(255)
    return ((x - np.array(MEAN, np.float32)) / np.array(STD, np.float32)).transpose(2, 0, 1).ravel()


def preprocess(size: int = 380):
    """A UDF from bytes to the network's input: RGB, resized, normalised, channels first, flat."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda data: _network_input((_decoded(data) or (None,))[0], size))

    return run


def preprocess_pixels(size: int = 380):
    """As ``preprocess``, from Spark's image structs."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(image: pd.DataFrame) -> pd.Series:
        return pd.Series([_network_input(_pixels(r) if r["data"] else None, size) for r in image.to_dict("records")])

    return run


def embedder(load_model):
    """A UDF from network input to an embedding; the model is loaded once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for inputs in batches:
            yield pd.Series([None if x is None else np.asarray(model(np.asarray(x, np.float32)), np.float32) for x in inputs])

    return run
