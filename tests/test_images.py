"""Resampling and containers, against values worked out by hand and by definition."""

import struct
import zlib

import numpy as np
import pytest

from lodestone.functions import images
from lodestone.plans.files import _chunk, _container, _png


def by_definition(line, out, kernel, reach, low=0.0, high=None):
    """One line of samples, sample by sample; weights have 22 binary digits."""
    n = len(line)
    scale = ((n if high is None else high) - low) / out
    stretch = max(scale, 1.0)
    result = []
    for o in range(out):
        centre = low + (o + 0.5) * scale
        taps = {i: kernel((i + 0.5 - centre) / stretch) for i in range(max(0, int(centre - reach * stretch + 0.5)), min(n, int(centre + reach * stretch + 0.5)))}
        total = sum(taps.values())
        whole = {i: int(w / total * 2**22 + (0.5 if w >= 0 else -0.5)) for i, w in taps.items()}
        result.append(min(255, max(0, sum(w * int(line[i]) for i, w in whole.items()) + 2**21 >> 22)))
    return result


def triangle(x):
    return max(0.0, 1 - abs(x))


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def line(values, out, kernel=images.TRIANGLE):
    return images.resample(np.array([values], np.uint8), 1, out, kernel)[0].tolist()


def test_lines_by_hand():
    # three samples of each half count 3 : 3 : 1, as the triangle is as wide as four
    assert line([0, 10, 20, 30], 2) == [7, 23]
    assert line([0, 255] * 4, 4) == [109, 128, 128, 146]
    assert line([0, 100], 4) == [0, 25, 75, 100]
    assert line([9, 9, 9, 200, 9, 9], 6) == [9, 9, 9, 200, 9, 9]
    assert line([0, 100], 4, images.CUBIC) == by_definition([0, 100], 4, cubic, 2.0)
    assert line([0, 0, 0, 255, 255, 255], 3, images.CUBIC) == by_definition([0, 0, 0, 255, 255, 255], 3, cubic, 2.0)


def test_a_checkerboard_turns_grey():
    board = (np.indices((8, 8)).sum(axis=0) % 2 * 255).astype(np.uint8)
    small = images.resample(board, 2, 2)
    assert abs(small.astype(int) - 128).max() <= 1
    spots = np.zeros((8, 8), np.uint8)
    spots[1::4, 1::4] = spots[2::4, 2::4] = spots[1::4, 2::4] = spots[2::4, 1::4] = 255
    assert images.resample(spots, 2, 2).min() > 40  # four samples near the corners would all be zero


@pytest.mark.parametrize("shape,out", [((13, 29), (4, 5)), ((7, 5), (20, 31)), ((31, 6), (6, 30)), ((9, 9), (9, 4))])
@pytest.mark.parametrize("kernel,plain,reach", [(images.TRIANGLE, triangle, 1.0), (images.CUBIC, cubic, 2.0)])
def test_pictures_by_definition(shape, out, kernel, plain, reach):
    pixels = np.random.default_rng(sum(shape)).integers(0, 256, (*shape, 3), dtype=np.uint8)
    got = images.resample(pixels, *out, kernel)
    for c in range(3):
        across = [by_definition(r, out[1], plain, reach) if out[1] != shape[1] else r for r in pixels[:, :, c].tolist()]
        down = [by_definition(r, out[0], plain, reach) if out[0] != shape[0] else r for r in np.array(across).T.tolist()]
        assert (got[:, :, c] == np.array(down).T).all()


def test_grey_and_blocks():
    assert images.grey_levels(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [7, 7, 7]]], np.uint8)).tolist() == [[76, 150, 29, 255, 7]]
    x = np.array([[0, 10, 20], [30, 41, 50], [1, 2, 4]], np.uint8)
    assert images._block_means(x, 2, 2).tolist() == [[20, 35], [2, 4]]


@pytest.mark.parametrize("h,w,size", [(400, 512, (400, 512)), (600, 300, (512, 256)), (700, 1000, (358, 512)), (3000, 2000, (512, 341)), (10, 5000, (1, 512))])
def test_thumbnails(h, w, size):
    grey = np.random.default_rng(h).integers(0, 256, (h, w), dtype=np.uint8)
    assert images.thumbnail(grey).shape == size
    # a slope stays a slope: means are kept, also through blocks
    slope = np.tile(np.linspace(0, 255, w).astype(np.uint8), (h, 1))
    assert abs(images.thumbnail(slope).mean() - slope.mean()) < 1


def test_sharpness():
    x = np.zeros((5, 5, 3), np.uint8)
    x[2, 2] = 10
    # the Laplacian is -40 at the point, 10 at its four neighbours, 0 at the corners: mean 0
    assert images.blur(x) == pytest.approx((1600 + 4 * 100) / 9)
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (1600, 1200, 3), dtype=np.uint8)
    small = images.thumbnail(images.grey_levels(noise)).astype(float)
    lap = small[:-2, 1:-1] + small[2:, 1:-1] + small[1:-1, :-2] + small[1:-1, 2:] - 4 * small[1:-1, 1:-1]
    assert images.blur(noise) == pytest.approx(lap.var()) and images.blur(noise[:2]) is None


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("exif", [True, False])
def test_containers(kind, exif):
    for stray in (True, False):
        data = _container(kind, 300, 41, exif, stray, False)
        assert images.container(data) == (300, 41, exif)
    for cut in (1, 8, 11, 20, len(data) // 2, len(data) - 3):
        assert images.container(data[:cut]) is None


def test_what_is_no_container():
    assert [images.container(x) for x in (None, b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xd9", b"RIFF", b"RIFF\x04\0\0\0WEBP", b"\x89PNG\r\n\x1a\n")] == [None] * 8
    whole = _png(np.zeros((3, 3), np.uint8))
    assert images.container(whole) == (3, 3, False)
    broken = bytearray(whole)
    broken[30] ^= 1  # a checksum no longer holds
    assert images.container(bytes(broken)) is None
    # EXIF without any tag counts as none
    empty = _png(np.zeros((3, 3), np.uint8), _chunk(b"eXIf", b"II*\0" + struct.pack("<IH", 8, 0)))
    assert images.container(empty) == (3, 3, False) and zlib.crc32(b"") == 0


def test_fill_bytes_and_markers_without_length():
    data = _container(0, 20, 10, True, False, False)
    assert images.container(data[:2] + b"\xff\xff" + data[2:]) == (20, 10, True)
    assert images.container(data[:2] + b"\xff\x01" + data[2:]) == (20, 10, True)


def test_pictures_are_measured_with_one_decoding_and_dealt_out_by_number(spark, monkeypatch):
    from lodestone.plans import files

    data = [_png(np.arange(n * 7 % 251, n * 7 % 251 + 12 * n, dtype=np.int64).reshape(n, 12).astype(np.uint8)) for n in (1, 2, 9, 40)] + [b"none", None]
    df = spark.createDataFrame(list(enumerate(data)), "i int, content binary")
    apart = df.select("i", images.inspect_image("content").alias("m"), images.blur_score("content").alias("blur"), images.preprocess(4)("content").alias("x")).select("i", "m.*", "blur", "x")
    assert df.select("i", images.measured(4)("content").alias("m")).select("i", "m.*").orderBy("i").collect() == apart.orderBy("i").collect()
    seen, decode = [], images.decode
    monkeypatch.setattr(images, "decode", lambda d: seen.append(d) or decode(d))
    images.measured(4).func(files.pd.Series(data))
    assert seen == data[:-1]
    monkeypatch.setattr(files, "_PICTURES", 20)
    dealt = files._dealt(spark, "/root/testdata/sf0.001")
    shares = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(shares) >= sum(shares) / 20 and max(shares) < 60 and sum(shares) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
