from __future__ import annotations

import numpy as np
import pytest

from hecespark.llm import media


def picture(h: int, w: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([127 + 100 * np.sin(x / 9), 127 + 100 * np.cos(y / 7), 127 + 60 * np.sin((x + y) / 11)], axis=2)
    return np.clip(base + rng.normal(0, 4, base.shape), 0, 255).astype(np.uint8)


def by_definition(rgb: np.ndarray, quality: int, subsampled: bool) -> np.ndarray:
    """Pixels from the coefficients that the encoder starts from, block by block, by the transform's definition."""
    h, w = rgb.shape[:2]
    planes = media.quantised(rgb, quality, subsampled)
    tables = [media.scaled(t, quality).reshape(64) for t in (media._LUMA, media._CHROMA, media._CHROMA)]
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1.0) / 2  # pixel, frequency
    full = []
    for i, p in enumerate(planes):
        rows, cols = p.shape[:2]
        out = np.zeros((rows * 8, cols * 8))
        for a in range(rows):
            for b in range(cols):
                zigzag = p[a, b].reshape(64).astype(float)
                block = np.zeros(64)
                block[media.ZIGZAG] = zigzag
                block *= tables[i]
                out[8 * a : 8 * a + 8, 8 * b : 8 * b + 8] = basis @ block.reshape(8, 8) @ basis.T
        out += 128
        full.append(out if i == 0 or not subsampled else out.repeat(2, 0).repeat(2, 1))
    y, cb, cr = (np.clip(np.rint(p[:h, :w]), 0, 255) for p in full)
    made = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    return np.clip(np.rint(made), 0, 255)


@pytest.mark.parametrize("size", [(8, 8), (1, 1), (24, 24), (17, 33), (64, 40)])
@pytest.mark.parametrize("subsampled", [True, False])
def test_decodes_what_was_encoded(size, subsampled):
    rgb = picture(*size)
    got, status = media.decode_jpeg(media.encode_jpeg(rgb, 85, subsampled))
    assert status == "ok" and got.shape == rgb.shape
    want = by_definition(rgb, 85, subsampled)
    assert np.abs(got.astype(float) - want).max() <= 2
    if min(size) > 8:
        assert np.abs(got.astype(float) - rgb).mean() < 12


def test_broken_pictures_have_a_status():
    data = media.encode_jpeg(picture(32, 32))
    assert media.decode_jpeg(b"") == (None, "corrupt")
    assert media.decode_jpeg(b"nothing")[1] == "corrupt"
    for cut in range(2, len(data), 97):
        got, status = media.decode_jpeg(data[:cut])
        assert status in ("truncated", "corrupt", "unsupported", "ok")
        assert (got is None) == (status in ("corrupt", "unsupported"))


def test_noise_never_crashes():
    rng = np.random.default_rng(3)
    data = bytearray(media.encode_jpeg(picture(24, 24)))
    for _ in range(60):
        d = bytearray(data)
        for at in rng.integers(2, len(d), 4):
            d[at] = int(rng.integers(256))
        assert media.decode_jpeg(bytes(d))[1] in ("ok", "truncated", "corrupt", "unsupported")


def test_column(spark):
    good = media.encode_jpeg(picture(16, 24))
    rows = [(1, good, "a"), (1, good, "a"), (None, good, "b"), (2, None, "c"), (3, b"", "d"), (4, good[:80], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, media binary, pixels string")
    got = media.decode(df, keep=("vec_id", "pixels")).collect()
    assert len(got) == len(rows)
    by = {(r["vec_id"], r["pixels"]): r for r in got}
    assert by[None, "b"]["height"] == 16 and by[None, "b"]["width"] == 24 and len(by[None, "b"]["rgb"]) == 16 * 24 * 3
    assert by[2, "c"]["status"] is None and by[2, "c"]["rgb"] is None
    assert by[3, "d"]["status"] == "corrupt" and by[3, "d"]["rgb"] is None
    assert media.decode(df.limit(0), keep=("vec_id",)).count() == 0
    with pytest.raises(ValueError):
        media.decode(df.withColumnRenamed("pixels", "RGB"), keep=("RGB",))


def test_thumbnails(spark):
    rows = [(1, [0.1] * 64), (2, None), (3, []), (4, [float("nan")] * 64), (None, [1.0, 2.0])]
    t = media.thumbnails(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = {r["vec_id"]: r["status"] for r in media.decode(t, keep=("vec_id",)).collect()}
    assert got == {1: "ok", 2: None, 3: None, 4: "ok", None: "ok"}


def foreign(spark, rgb, progressive=False, grey=False, sampling=None, restart=0, quality=0.9):
    """A file by another encoder (the Java runtime's), and its own pixels of it."""
    j = spark._jvm
    h, w = rgb.shape[:2]
    image = j.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in rgb[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    options = writer.getDefaultWriteParam()
    options.setCompressionMode(2)
    options.setCompressionQuality(quality)
    if progressive:
        options.setProgressiveMode(1)
    metadata = writer.getDefaultImageMetadata(j.javax.imageio.ImageTypeSpecifier(image), options)
    if sampling or restart:
        tree = metadata.getAsTree("javax_imageio_jpeg_image_1.0")
        sequence = tree.getLastChild()
        if sampling:
            found = sequence.getElementsByTagName("componentSpec")
            for k, (a, b) in enumerate(sampling):
                found.item(k).setAttribute("HsamplingFactor", str(a))
                found.item(k).setAttribute("VsamplingFactor", str(b))
        if restart:
            node = j.javax.imageio.metadata.IIOMetadataNode("dri")
            node.setAttribute("interval", str(restart))
            sequence.insertBefore(node, sequence.getFirstChild())
        metadata.setFromTree("javax_imageio_jpeg_image_1.0", tree)
    out = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, j.javax.imageio.IIOImage(image, None, metadata), options)
    stream.close()
    data = bytes(out.toByteArray())
    back = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(bytearray(data)))
    if grey:  # samples as they are: getRGB takes grey for linear light
        raster = back.getRaster()
        return data, np.repeat(np.array([[raster.getSample(x, y, 0) for x in range(w)] for y in range(h)], np.int64)[:, :, None], 3, axis=2)
    pixels = np.array([[back.getRGB(x, y) for x in range(w)] for y in range(h)], np.int64)
    return data, np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], axis=2)


FULL, WIDE, HALF = [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]


@pytest.mark.parametrize("options", [{}, {"progressive": True}, {"grey": True}, {"grey": True, "progressive": True}, {"sampling": WIDE}, {"sampling": WIDE, "progressive": True}, {"sampling": FULL, "progressive": True}, {"restart": 2}, {"restart": 1, "sampling": FULL}, {"quality": 0.2, "progressive": True}], ids=str)
def test_files_of_another_encoder(spark, options):
    """Baseline, progressive (with runs of ended bands over several blocks), grey, other samplings and restart intervals, against another decoder's pixels."""
    y, x = np.mgrid[0:37, 0:51]
    smooth = np.stack([127 + 90 * np.sin(x / 17), 127 + 90 * np.cos(y / 15), 127 + 60 * np.sin((x + y) / 21)], axis=2).astype(np.uint8)
    data, want = foreign(spark, smooth, **options)
    assert (b"\xff\xc2" in data) == bool(options.get("progressive"))
    got, status = media.decode_jpeg(data)
    assert status == "ok" and got.shape == want.shape
    error = np.abs(got.astype(int) - want)
    exact = options.get("grey") or options.get("sampling") == FULL
    # the other decoder smooths chroma that it enlarges, which this one repeats
    assert (error.max() <= (4 if options.get("grey") else 6)) if exact else (error.mean() < 4 and np.quantile(error, 0.9) <= 12), (error.max(), error.mean())


def test_headers_that_promise_too_much():
    """A few bytes can't make a task allocate gigabytes."""
    import tracemalloc

    header = b"\xff\xd8" + media.segment(0xC2, bytes([8]) + (8192).to_bytes(2, "big") * 2 + bytes([1, 1, 0x11, 0]))
    tracemalloc.start()
    assert media.decode_jpeg(header) == (None, "corrupt")
    assert media.decode_jpeg(header.replace((8192).to_bytes(2, "big") * 2, b"\xff\xff\xff\xff")) == (None, "unsupported")
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


def test_random_bytes_have_a_status():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 3, 10, 100, 3000):
        for start in (b"", b"\xff\xd8", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00"):
            assert media.decode_jpeg(start + rng.bytes(n))[1] in ("ok", "truncated", "corrupt", "unsupported")
