"""The image source: round trips, filters of PNG lines, files that are none, partitions by size."""

import zlib

import numpy as np
import pytest

from platen.sources import images


def filtered_png(pixels, kinds):
    """A PNG whose lines use the given filters, written the plain way."""
    h, w, n = pixels.shape
    p = pixels.astype(int)
    at = lambda y, x: p[y, x] if y >= 0 and x >= 0 else np.zeros(n, int)
    raw = b""
    for y in range(h):
        line = []
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            near = [min((abs(q + r - s - v), k, v) for k, v in enumerate((q, r, s)))[2] for q, r, s in zip(a, b, c, strict=True)]
            line.append((p[y, x] - [0 * a, a, b, (a + b) // 2, np.array(near)][kinds[y % len(kinds)]]) % 256)
        raw += bytes([kinds[y % len(kinds)]]) + np.array(line, np.uint8).tobytes()
    made = images.encode(pixels)
    start, end = made.index(b"IDAT") - 4, made.index(b"IEND") - 4
    body = b"IDAT" + zlib.compress(raw)
    return made[:start] + (len(body) - 4).to_bytes(4, "big") + body + zlib.crc32(body).to_bytes(4, "big") + made[end:]


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_lines_of_every_filter(channels):
    p = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    assert (images.decode(images.encode(p)) == p).all()
    for kinds in ((1,), (2,), (3,), (4,), (4, 0, 3, 1, 2)):
        assert (images.decode(filtered_png(p, kinds)) == p).all()


def test_files_that_are_none_are_told_apart():
    p = np.zeros((4, 5, 3), np.uint8)
    good = images.encode(p)
    for bad in (b"", b"no image", good[:40], good[:-20], good[:30] + b"x" + good[31:], b"P6 5 4 255\n", b"P5 5 4 65535\n" + bytes(40), b"P6 x"):
        with pytest.raises((images.BadImage, ValueError)):
            images.decode(bad)
    with pytest.raises(images.BadImage):
        images.decode(good, most=19)
    assert (images.decode(b"P6\n# made by hand\n5 4\n255\n" + bytes(60)) == p).all() and images.decode(b"P5 2 1 255 \x07\x08").tolist() == [[[7], [8]]]


def test_a_folder_of_images_becomes_rows_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {f"a{k}.png": rng.integers(0, 256, (3 + k, 4, 3)).astype(np.uint8) for k in range(6)}
    for name, p in made.items():
        (tmp_path / name).write_bytes(images.encode(p))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.pgm").write_bytes(b"P5 2 1 255 \x07\x08")
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    read = images.image_scan(spark, str(tmp_path), partitionBytes="300")
    assert read.rdd.getNumPartitions() > 2
    rows = {r.name: r for r in read.collect()}
    assert set(rows) == {*made, "g.pgm"} and (rows["g.pgm"].width, rows["g.pgm"].channels) == (2, 1)
    for name, p in made.items():
        r = rows[name]
        assert (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) == p).all() and r.length == (tmp_path / name).stat().st_size
    px = images.as_pixels(read, "name").collect()
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in px if r.name == "g.pgm"} == {(0, 0): (7, 7, 7), (0, 1): (8, 8, 8)}
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in px if r.name == "a2.png"} == {(y, x): tuple(made["a2.png"][y, x]) for y in range(5) for x in range(4)}
    assert images.image_scan(spark, str(tmp_path), glob="*.pgm").count() == 1
    with pytest.raises(Exception, match="broken"):
        images.image_scan(spark, str(tmp_path), dropInvalid="false").count()
    out = tmp_path / "out"
    read.where("channels = 3").write.format(images.NAME).mode("append").save(str(out))
    assert {r.name: bytes(r.data) for r in images.image_scan(spark, str(out)).collect()} == {n: p.tobytes() for n, p in made.items()}


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert images.image_scan(spark, str(tmp_path)).count() == 0
