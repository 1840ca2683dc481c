"""Detection without a model and connected parts against plain numpy."""

import numpy as np
import pytest

from platen.operators import classic, parts


def raster(spark, image, scan=0):
    h, w = image.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    rows = [(scan, int(a), int(b), *map(int, c)) for a, b, c in zip(y, x, image.reshape(-1, 3), strict=True)]
    return rows, (scan, w, h)


def filtered(a, taps, axis):
    r = len(taps) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    p = np.pad(a, pad, mode="reflect")
    return sum(t * np.take(p, range(k, k + a.shape[axis]), axis) for k, t in enumerate(taps))


def plain_box(image, blur=31, close=35, open_=15):
    """The mask stage and the box of its largest part, by whole arrays."""
    r, g, b = (image[..., k].astype(np.int64) for k in range(3))
    grey = (4899 * r + 9617 * g + 1868 * b + 8192) >> 14
    top, low = image.max(-1).astype(float), image.min(-1).astype(float)
    s = np.floor(np.divide((top - low) * 255, top, out=np.zeros_like(top), where=top > 0) + 0.5).astype(np.int64)
    soft = (filtered(filtered(grey, (1, 4, 6, 4, 1), 1), (1, 4, 6, 4, 1), 0) + 128) >> 8
    gx = np.abs(filtered(filtered(soft, (1, 2, 1), 0), (-1, 0, 1), 1))
    gy = np.abs(filtered(filtered(soft, (-1, 0, 1), 0), (1, 2, 1), 1))
    score = np.zeros(grey.shape)
    for plane in (gx + gy, s):
        m = filtered(filtered(plane, (1,) * blur, 1), (1,) * blur, 0)
        score = score + ((m - m.min()) * 255.0 / (m.max() - m.min()) if m.max() > m.min() else 0.0)
    mask = score > np.percentile(score, 55)

    def square(m, size, f, fill):
        q = np.pad(m, size // 2, constant_values=fill)
        return f([q[i : i + m.shape[0], j : j + m.shape[1]] for i in range(size) for j in range(size)], axis=0)

    wide, narrow = lambda m, n: square(m, n, np.max, False), lambda m, n: square(m, n, np.min, True)
    mask = wide(narrow(narrow(wide(mask, close), close), open_), open_)
    seen, best = np.zeros(mask.shape, bool), (0, None)
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        if len(cells) > best[0]:
            ys, xs = zip(*cells, strict=True)
            best = (len(cells), (min(xs), min(ys), max(xs), max(ys)))
    return mask, best[1], gx, gy


def plain_detection(image, *kernels):
    """(box in shares, found), one side after another."""
    mask, best, gx, gy = plain_box(image, *kernels)
    h, w = mask.shape
    box, found = (0.02, 0.02, 0.98, 0.98), False
    if best and (best[2] - best[0] + 1) * (best[3] - best[1] + 1) > 0.15 * w * h:
        pad, found = int(0.004 * max(w, h)), True
        box = (max(0, (best[0] - pad) / w), max(0, (best[1] - pad) / h), min(1, (best[2] + 1 + pad) / w), min(1, (best[3] + 1 + pad) / h))
    px = [int(box[0] * w), int(box[1] * h), int(box[2] * w), int(box[3] * h)]
    qx, qy = (px[2] - px[0]) // 4, (px[3] - px[1]) // 4
    profiles = {0: gx[px[1] + qy : px[3] - qy].mean(axis=0), 1: gy[:, px[0] + qx : px[2] - qx].mean(axis=1)}
    new = list(px)
    for k, sign in enumerate((-1, -1, 1, 1)):
        p = profiles[k % 2]
        out, into = int(len(p) * 0.06), int(int(len(p) * 0.06) * 0.2)
        low, high = max(0, px[k] - (out if sign < 0 else into)), min(len(p), px[k] + (into if sign < 0 else out))
        if high - low >= 5 and p[low:high].max() > (np.median(p) or 1.0) * 4:
            new[k] = low + int(np.argmax(p[low:high]))
    if new[2] - new[0] < w * 0.2 or new[3] - new[1] < h * 0.2:
        return box, found
    return tuple(min(1.0, max(0.0, v / n)) for v, n in zip(new, (w, h, w, h), strict=True)), found


def page(rng, h, w, box):
    """A page with lines of print on a plain bed."""
    image = np.full((h, w, 3), 200, np.uint8) + rng.integers(0, 3, (h, w, 3)).astype(np.uint8)
    x0, y0, x1, y1 = box
    image[y0:y1, x0:x1] = (250, 248, 235)
    for y in range(y0 + 6, y1 - 6, 7):
        image[y : y + 2, x0 + 6 : x1 - 6] = rng.integers(0, 120, (1, x1 - x0 - 12, 1))
    return image


def test_detect_classic_finds_pages_and_falls_back(spark):
    rng = np.random.default_rng(1)
    images = [page(rng, 110, 150, (40, 25, 120, 90)), np.full((40, 60, 3), 180, np.uint8), page(rng, 60, 64, (4, 6, 40, 50)), page(rng, 100, 90, (3, 4, 86, 95))]
    made = [raster(spark, im, k) for k, im in enumerate(images)]
    pixels = spark.createDataFrame([r for rows, _ in made for r in rows], "scan_id long, y int, x int, r int, g int, b int")
    frames = spark.createDataFrame([f for _, f in made], "scan_id long, width int, height int")
    kernels = {"blur": 9, "close": 11, "open_": 7}
    mask = classic.classic_mask(classic.slopes(pixels, frames), **kernels).collect()
    got = {r.scan_id: r for r in classic.detect_classic(pixels, frames, **kernels).collect()}
    for k, image in enumerate(images):
        want = plain_box(image, 9, 11, 7)[0]
        assert {(r.y, r.x) for r in mask if r.scan_id == k} == set(map(tuple, np.argwhere(want).tolist()))
        box, found = plain_detection(image, 9, 11, 7)
        assert got[k].found == found and np.allclose(got[k][1:5], box, atol=1e-12)
    assert [got[k].found for k in range(4)] == [True, False, True, True]


def test_mirrored_frames_of_one_and_two_pixels(spark):
    for n in (1, 2, 3, 9):
        p = spark.createDataFrame([(0, 0, x, x, n, 1) for x in range(n)], "scan_id int, y int, x int, v int, width int, height int")
        got = [r.v for r in classic.mirrored(p, "x", 4).orderBy("x").collect()]
        assert got == (np.pad(np.arange(n), 4, mode="reflect").tolist() if n > 1 else [0] * 9)


def test_ranked_value_is_the_order_statistic(spark):
    rng = np.random.default_rng(2)
    values = {0: rng.random(501) * 500, 1: np.repeat(7.25, 40), 2: np.array([3.0]), 3: np.round(rng.random(64) * 4) - 2.0005}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "scan_id int, score double")
    for share in (0.0, 0.55, 1.0):
        got = {r.scan_id: r.cut for r in classic.ranked_value(df, "scan_id", "score", share).collect()}
        assert got == {k: np.sort(v)[int(share * (len(v) - 1))] for k, v in values.items()}


def spiral(turns):
    """Row runs of one line that winds `turns` times, a cell wide with a cell between."""
    n = 4 * turns + 1
    grid = np.zeros((n, n), bool)
    y, x, length = 0, 0, n
    for k in range(2 * turns + 1):
        dy, dx = ((0, 1), (1, 0), (0, -1), (-1, 0))[k % 4]
        ys, xs = y + dy * np.arange(length), x + dx * np.arange(length)
        grid[ys, xs] = True
        y, x = ys[-1], xs[-1]
        if k % 2 == 0 and k:
            length -= 2
        if length < 2:
            break
    return grid


@pytest.mark.parametrize("band", [1, 4, 64])
def test_parts_are_those_of_a_flood(spark, band):
    rng = np.random.default_rng(band)
    masks = {0: rng.random((90, 70)) < 0.4, 1: spiral(12), 2: np.zeros((5, 5), bool), 3: np.eye(70, dtype=bool)}
    cells = spark.createDataFrame([(k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)] + [(3, 0, 0)], "mask_id long, y int, x int")
    got = {}
    for r in parts.connected_components(cells, 200, band=band).collect():
        got[r.mask_id, r.y, r.x] = r.label
    assert len(got) == sum(m.sum() for m in masks.values())
    for k, m in masks.items():
        label, want = 0, {}
        for y, x in np.argwhere(m).tolist():
            if (y, x) in want:
                continue
            label += 1
            todo = [(y, x)]
            want[y, x] = label
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(m.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(m.shape[1], b + 2)):
                        if m[c, d] and (c, d) not in want:
                            want[c, d] = label
                            todo.append((c, d))
        assert all(got[k, y, x] == n for (y, x), n in want.items())


def test_a_long_chain_takes_few_rounds(spark):
    n = 5_000
    links = spark.range(n - 1).selectExpr("0L AS mask_id", "id AS u", "id + 1 AS v")
    roots, rounds = parts.star_roots(links, "mask_id")
    assert rounds <= 14 and roots.where("root != 0").count() == 0 and roots.count() == n - 1
    with pytest.raises(RuntimeError):
        parts.star_roots(links, "mask_id", 3)
