"""Cases of a review: frames that a task takes whole, and larger ones, give the same."""

import numpy as np
from test_classic import page, plain_box, plain_detection, raster

SF = "/root/testdata/sf0.001"
KERNELS = {"blur": 5, "close": 7, "open_": 5}


def test_frames_of_any_size_have_the_same_mask(spark, monkeypatch):
    from platen.operators import classic

    rng = np.random.default_rng(1)
    images = [page(rng, 40, 60, (10, 8, 50, 34)), page(rng, 20, 24, (3, 3, 20, 17)), rng.integers(0, 255, (1, 30, 3)).astype(np.uint8), rng.integers(0, 255, (2, 24, 3)).astype(np.uint8)]
    made = [raster(spark, im, k) for k, im in enumerate(images)]
    pixels = spark.createDataFrame([r for rows, _ in made for r in rows] + [(1, 20, 0, 1, 2, 3)], "scan_id long, y int, x int, r int, g int, b int")
    frames = spark.createDataFrame([f for _, f in made], "scan_id long, width int, height int")
    monkeypatch.setattr(classic, "WHOLE", 500)
    got = [tuple(r) for r in classic.whole_mask(classic.colour_runs(pixels), frames, **KERNELS).collect()]
    for k, image in enumerate(images):
        assert sorted(r[1:] for r in got if r[0] == k) == sorted(map(tuple, np.argwhere(plain_box(image, 5, 7, 5)[0]).tolist()))


def test_masks_need_no_windows_over_pixels(spark):
    from platen.plans import catalog

    plan = catalog.QUERIES["ra7_classic_mask"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 3


def test_frames_taken_whole_are_detected(spark):
    from platen.operators import classic

    rng = np.random.default_rng(4)
    images = [page(rng, 110, 150, (40, 25, 120, 90)), np.full((40, 150, 3), 180, np.uint8), page(rng, 60, 64, (4, 6, 40, 50))]
    made = [raster(spark, im, k) for k, im in enumerate(images)]
    pixels = spark.createDataFrame([r for rows, _ in made for r in rows], "scan_id long, y int, x int, r int, g int, b int")
    frames = spark.createDataFrame([f for _, f in made], "scan_id long, width int, height int")
    found = classic.detect_classic(classic.colour_runs(pixels), frames, blur=9, close=11, open_=7)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.scan_id: r for r in found.collect()}
    for k, image in enumerate(images):
        box, was = plain_detection(image, 9, 11, 7)
        assert got[k].found == was and np.allclose(got[k][1:5], box, atol=1e-12)
