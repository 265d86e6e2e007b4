import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo as G
from lodestone.functions import images
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.plans.files import _container


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["v"] for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_slugs_and_names(spark):
    assert values(spark, X.slugify, ["  A--B (x) ", "", None, "Atta texana", "é!"]) == ["a-b-x", "", None, "atta-texana", ""]
    assert values(spark, X.display_name, ["atta-texana", "x", ""]) == ["Atta texana", "X", ""]
    assert values(spark, X.genus, [" Atta  texana b", "", "One"]) == ["Atta", "", "One"]
    assert values(spark, X.epithet, [" Atta  texana b", "", "One"]) == ["texana", "", ""]
    assert values(spark, X.squeeze, [" a \t b\n"]) == ["a b"]


def test_urls(spark):
    urls = ["h/medium.JPG?1", "h/a.jpeg", "h/a.gif", "h/x", "h/a.png?u=/b", "h/b.webp"]
    assert values(spark, X.url_extension, urls) == ["jpg", "jpeg", "jpg", "jpg", "jpg", "webp"]
    assert values(spark, X.resize_url, ["square/x/square.jpg"]) == ["medium/x/medium.jpg"]
    assert values(spark, X.uri_backend, ["gs://b/x", "s3://b", "/tmp"]) == ["gcs", "s3", "file"]
    assert values(spark, X.uri_bucket, ["gs://b/x", "bucket"]) == ["b", "bucket"]
    assert values(spark, lambda c: X.sample_key(F.lit("s"), c), ["/a/b/c.d.jpg", "x", ".hidden"]) == ["s/c.d", "s/x", "s/.hidden"]
    assert values(spark, lambda c: X.object_key(F.lit("s"), c, F.lit("jpg"), "/p/"), ["7"]) == ["p/s/7.jpg"]
    assert values(spark, lambda c: X.numbered_name("antweb", c), [7], "int") == ["antweb_007.jpg"]


def test_numbers(spark):
    places = values(spark, X.parse_location, ["1.5,-2", "1.5", "a,1", "1,2,3", None, ","])
    assert [tuple(p) for p in places] == [(1.5, -2.0)] + [(None, None)] * 5
    assert values(spark, X.to_double, ["1.5", " 2 ", "", "x", "nan", None]) == [1.5, 2.0, None, None, None, None]
    assert values(spark, X.to_int, ["12", "12.0", "", " -3 ", "99999999999"]) == [12, None, None, -3, None]
    assert values(spark, lambda c: X.default_if_blank(c, "jpg"), ["", " ", None, "png"]) == ["jpg", "jpg", "jpg", "png"]
    assert values(spark, lambda c: X.percentage(c, F.lit(3)), [1, 0], "int") == [33.33, 0.0]
    assert values(spark, lambda c: X.percentage(F.lit(1), c), [0], "int") == [0.0]
    assert values(spark, lambda c: X.quota(F.lit(10), c), [3, 20], "int") == [4, 1]
    assert values(spark, lambda c: X.clamp(c, 0.0, 1.0), [-1.0, 0.5, 2.0], "double") == [0.0, 0.5, 1.0]
    assert values(spark, X.status_message, [422, 500, None], "int")[1:] == ["The service failed with status 500.", "No connection to the service."]


def test_cells(spark):
    assert values(spark, G.cell, [-0.5, 42.27, 43.0, None], "double") == [-1, 42, 43, None]
    assert values(spark, lambda c: G.usable(c, F.lit(1.0)), [1.0, float("nan"), None], "double") == [True, False, False]
    assert values(spark, lambda c: G.both_or_none(c, F.lit(None).cast("double")), [1.0, None], "double") == [False, True]


def test_vectors(spark):
    assert values(spark, lambda c: V.l2_normalise(V.doubles(c)), [[3.0, 4.0], [0.0, 0.0]], "array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, lambda c: F.round(V.cosine(V.doubles(c), F.array(F.lit(1.0), F.lit(0.0))), 6), [[2.0, 0.0], [0.0, 1.0]], "array<float>") == [1.0, 0.0]


def test_normalising_takes_time_in_proportion_to_the_width(spark):
    v = F.expr("transform(sequence(1, 1792), x -> cast(x as double))")
    out = spark.range(300).select(F.aggregate(V.l2_normalise(v), F.lit(0.0), lambda s, x: s + x * x).alias("n"))
    assert [r["n"] for r in out.distinct().collect()] == [pytest.approx(1.0)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("sqrt(") == 1


def test_reported_similarities_are_rounded_by_their_binary_value(spark):
    rng = np.random.default_rng(4)
    values_ = [0.12355, 0.03125, -0.03125, 0.09375, 0.00005, 0.00015, 1e-9, 0.0, -0.00004, 1.0, -1.0, 0.99995, 1.00005, 0.5, 2.0**-10, 0.00095]
    values_ += [k / 20000 for k in range(1, 400, 2)] + rng.uniform(-1, 1, 300).tolist() + rng.uniform(-1e-3, 1e-3, 100).tolist()
    assert values(spark, V.reported, values_, "double") == [round(x, 4) for x in values_]
    assert values(spark, V.reported, [None, 3.14159], "double") == [None, 3.1416]


def test_formats_without_a_decoder_are_not_corrupt(spark):
    try:
        import PIL  # noqa: F401

        pytest.skip("Pillow decodes them")
    except ImportError:
        pass
    df = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0 a photo"),)], "content binary")
    for f in (images.blur_score, images.preprocess(4)):
        with pytest.raises(Exception, match="JPEG needs Pillow"):
            df.select(f("content")).collect()
    with pytest.raises(Exception, match="GIF needs Pillow"):
        spark.createDataFrame([(bytearray(b"GIF89a"),)], "content binary").select(images.inspect_image("content")).collect()
    whole = bytearray(_container(0, 9, 8, True, False, False))
    sizes = spark.createDataFrame([(whole,), (whole[:50],)], "content binary").select(images.inspect_image("content").alias("m")).collect()
    assert [r["m"] and tuple(r["m"]) for r in sizes] == [(9, 8, True), (None, None, None)]


def png(pixels, filters=None):
    h, w, c = pixels.shape
    raw = b""
    flat = pixels.reshape(h, w * c).astype(int)
    for y in range(h):
        kind = 0 if filters is None else filters[y % len(filters)]
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left = np.concatenate([np.zeros(c, int), flat[y][:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        near = np.abs(np.stack([p - left, p - up, p - corner])).argmin(axis=0)
        guess = [0, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        raw += bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_decoding(channels):
    pixels = np.random.default_rng(0).integers(0, 256, (9, 7, channels), dtype=np.uint8)
    assert (images._png(png(pixels, [0, 1, 2, 3, 4])) == pixels).all()


def test_image_functions(spark):
    rng = np.random.default_rng(1)
    sharp, flat = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8), np.full((40, 30, 3), 7, np.uint8)
    tiny = np.zeros((2, 2, 3), np.uint8)
    df = spark.createDataFrame([(0, png(sharp)), (1, png(flat)), (2, png(tiny)), (3, b"no image")], "i int, content binary")
    got = df.select("i", images.inspect_image("content").alias("m"), images.blur_score("content").alias("b"), images.preprocess(8)("content").alias("x")).orderBy("i").collect()
    assert [(r["m"]["width"], r["m"]["height"], r["m"]["has_exif"]) for r in got] == [(30, 40, False), (30, 40, False), (2, 2, False), (None, None, None)]
    assert got[0]["b"] > 1000 and got[1]["b"] == pytest.approx(0) and got[2]["b"] is None and got[3]["b"] is None
    assert len(got[0]["x"]) == 3 * 64 and got[3]["x"] is None
    assert got[1]["x"][0] == pytest.approx((7 / 255 - images.MEAN[0]) / images.STD[0], abs=1e-5)
    embed = images.embedder(lambda: lambda x: x[:2] * 2)
    assert df.select(embed(images.preprocess(8)("content")).alias("e")).where("e is not null").count() == 3
