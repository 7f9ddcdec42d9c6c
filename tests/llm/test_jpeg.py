import numpy as np
import pytest

from weftgraph.llm import jpeg as j

SMOOTH = np.add.outer(np.arange(37), np.arange(50))


@pytest.mark.parametrize("size", [(16, 16), (17, 33), (8, 8), (1, 1), (40, 25)])
@pytest.mark.parametrize("subsample", [True, False])
@pytest.mark.parametrize("interval", [0, 2])
def test_coefficients_come_back(size, subsample, interval):
    rng = np.random.default_rng(sum(size))
    w, h = size
    f = 2 if subsample else 1
    sampling = [(f, f), (1, 1), (1, 1)]
    blocks = []
    for a, b in sampling:
        rows, columns = -(-h // (8 * f)) * b, -(-w // (8 * f)) * a
        block = rng.integers(-40, 40, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < 0.15)
        block[..., 0] = rng.integers(-200, 200, (rows, columns))
        blocks.append(block)
    picture = j.Picture(j.encode_blocks(blocks, w, h, sampling, np.full(64, 3), interval))
    assert picture.progressive and picture.scans == len(j.SCRIPT)
    for block, c in zip(blocks, picture.components):
        got = np.array(c.coefficients).reshape(c.rows, c.columns, 64)
        own = np.zeros_like(block)
        own[..., 0] = block[..., 0]
        # blocks beyond the picture have a DC coefficient alone
        own[: c.own_rows, : c.own_columns] = block[: c.own_rows, : c.own_columns]
        assert (got == own).all()


def test_dense_coefficients():
    rng = np.random.default_rng(9)
    blocks = [rng.integers(-1000, 1000, (3, 5, 64))]
    got = j.Picture(j.encode_blocks(blocks, 40, 24, [(1, 1)], np.full(64, 1))).components[0].coefficients
    assert (np.array(got).reshape(3, 5, 64) == blocks[0]).all()


@pytest.mark.parametrize("subsample", [True, False])
def test_picture(subsample):
    rgb = np.stack([SMOOTH * 2, SMOOTH + 60, 200 - SMOOTH], 2).clip(0, 255).astype(np.uint8)
    pixels, scans = j.decode(j.encode(rgb, 2, subsample))
    assert pixels.shape == rgb.shape and scans == 10
    assert np.abs(pixels.astype(int) - rgb).mean() < 1


def test_transform_by_force():
    rng = np.random.default_rng(4)
    block = rng.integers(-50, 50, 64)
    natural = np.zeros((8, 8))
    natural.flat[j.ZIGZAG] = block
    c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(c(u) * c(v) * natural[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
    assert np.allclose(j.BASIS.T @ natural @ j.BASIS, want)


def test_column(spark):
    good = j.encode(np.full((9, 5, 3), 100, np.uint8))
    rows = [(1, good, "a"), (None, good, "b"), (1, good, "c"), (2, None, "d"), (3, b"", "e"), (4, b"no picture", "f"), (5, good[: len(good) // 2], "g"), (6, good[:-30], "h"), (7, b"\xff\xd8\xff\xd9", "i")]
    media = spark.createDataFrame([(a, bytearray(b) if b is not None else None, c) for a, b, c in rows], "vec_id long, image binary, width string")
    got = j.decode_column(media, "image")
    assert got.columns == ["vec_id", "width", "_width", "height", "scans", "pixels", "error"]
    found = {r.width: r for r in got.collect()}
    assert all(len(found[k].pixels) == 9 * 5 * 3 and found[k].error is None for k in "abc")
    assert all(found[k].pixels is None and found[k].error for k in "defi")
    assert j.decode_column(media.limit(0), "image").count() == 0


def test_vectors(spark):
    rows = [(1, [0.5, -0.5, 0.1, 0.2]), (2, []), (3, None), (4, [float("nan"), None, float("inf")]), (5, [0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in j.decode_column(j.pictures(frame), "image").collect()}
    assert got[1].width == 6 and got[4].width == 6 and got[5].width == 3 and got[2].error == got[3].error == "no file"
    want = j.picture_of(rows[0][1]).astype(int)
    assert np.abs(np.frombuffer(got[1].pixels, np.uint8).reshape(6, 6, 3).mean() - want.mean()) < 8


def other_encoder(spark, rgb, quality, progressive):
    """A file that the Java library's own encoder makes of the pixels."""
    jvm = spark.sparkContext._jvm
    height, width = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    sink = jvm.java.io.ByteArrayOutputStream()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(sink)
    writer.setOutput(out)
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    return bytes(sink.toByteArray())


def other_decoder(spark, data):
    """Pixels of a file by the Java library's own decoder."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    height, width = image.getHeight(), image.getWidth()
    return np.array([[[image.getRGB(x, y) >> k & 255 for k in (16, 8, 0)] for x in range(width)] for y in range(height)])


@pytest.mark.parametrize("progressive", [True, False])
@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_files_of_another_encoder(spark, progressive, quality):
    rng = np.random.default_rng(3)
    rgb = np.stack([SMOOTH * 2, SMOOTH + 60, 200 - SMOOTH], 2).clip(0, 255)
    rgb[10:20, 12:30] = rng.integers(0, 256, (10, 18, 3))
    data = other_encoder(spark, rgb, quality, progressive)
    assert (b"\xff\xc2" in data) == progressive
    pixels, scans = j.decode(data)
    assert (scans > 1) == progressive and pixels.shape == rgb.shape
    want = other_decoder(spark, data)
    # that decoder smooths chroma between samples; grey is the same
    grey = lambda a: a @ np.array([0.299, 0.587, 0.114])
    assert np.abs(grey(pixels.astype(float)) - grey(want)).mean() < 3
    assert np.abs(pixels[:8, :8].astype(int) - want[:8, :8]).mean() < 3


def test_another_decoder_reads_ours(spark):
    rgb = np.stack([SMOOTH * 2, SMOOTH + 60, 200 - SMOOTH], 2).clip(0, 255).astype(np.uint8)
    for interval in (0, 3):
        data = j.encode(rgb, 3, False, interval)
        assert np.abs(j.decode(data)[0].astype(int) - other_decoder(spark, data)).max() <= 2


def test_damaged_files():
    """Ten thousand damaged files are decoded or say what is wrong, and never more."""
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (9, 14, 3)).astype(np.uint8)
    files = [j.encode(rgb, q, s, i) for q in (1, 9) for s in (True, False) for i in (0, 1)]
    seen = set()
    for k in range(10_000):
        data = bytearray(files[k % len(files)])
        for _ in range(1 + k % 4):
            data[rng.integers(2, len(data) if k % 3 else 200)] = rng.integers(0, 256)
        if k % 5 == 0:
            del data[rng.integers(2, len(data)) :]
        try:
            pixels, _ = j.decode(bytes(data))
            assert pixels.ndim == 3 and pixels.dtype == np.uint8
        except j.JpegError as e:
            seen.add(str(e))
    assert len(seen) > 3


def test_claimed_size_is_bounded_by_the_file():
    data = bytearray(j.encode(np.full((9, 9, 3), 7, np.uint8)))
    at = data.index(b"\xff\xc2") + 5
    data[at : at + 4] = b"\xff\xff\xff\xff"
    with pytest.raises(j.JpegError):
        j.decode(bytes(data))
    data[at : at + 4] = b"\x40\x00\x40\x00"
    with pytest.raises(j.JpegError, match="too short"):
        j.decode(bytes(data))


def test_larger_picture_and_bounded_batches(spark):
    rgb = np.tile(np.arange(256, dtype=np.uint8)[:, None, None], (3, 700, 3))
    data = j.encode(rgb, 40)
    pixels, _ = j.decode(data)
    assert pixels.shape == rgb.shape and np.abs(pixels.astype(int) - rgb).mean() < 20
    media = spark.createDataFrame([(k, bytearray(data)) for k in range(14)], "vec_id long, image binary").coalesce(1)
    got = j.decode_column(media, "image").selectExpr("vec_id", "length(pixels) as n", "error").collect()
    assert sorted(r.vec_id for r in got) == list(range(14)) and all(r.n == rgb.size and r.error is None for r in got)
