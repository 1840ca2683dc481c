"""Cases of a review: rasters of texts travel as runs, and what is decided for whole scans is decided by tasks first."""

import numpy as np

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def planned(spark, name):
    from platen.plans import catalog

    return plan_of(catalog.QUERIES[name](spark, SF))


def test_trim_exchanges_runs_and_no_pixels(spark):
    plan = planned(spark, "ra23_trim_to_mask")
    # No pixel is numbered in a window or met in a join: rows of pixels are only made at the end.
    assert "row_number" not in plan and "v#" not in "".join(line for line in plan.splitlines() if "Join" in line or "hashpartitioning" in line) and plan.count("MapInArrow") > 2


def test_runs_of_texts_are_the_pixels(spark, tmp_path):
    from platen.operators import bands
    from platen.sources.derived import Views

    texts = [(k, t) for k, t in enumerate(["", None, "a b", "\U0001f600 é" * 40, "x" * 161, " " * 80])]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    pixels = bands.each_pixel(v("pixel_runs"), lambda a, _: a, "int", ()).toPandas()
    order = ["scan_id", "y", "x", "v"]
    assert np.array_equal(pixels.sort_values(order)[order], v("pixels").toPandas().sort_values(order)[order])
    assert v("pixel_runs").toPandas().groupby("scan_id")["height"].first().to_dict() == {2: 1, 3: 2, 4: 3, 5: 1}


def test_trim_takes_no_more_than_its_share_in_order(spark):
    from platen.operators import masks

    # A triangle: what lies over its long side is outside. 40 x 30 pixels, of which 0.009 are 10.
    v = np.random.default_rng(3).integers(0, 200, (30, 40))
    y, x = np.divmod(np.arange(1200), 40)
    pixels = spark.createDataFrame([(m, int(b), int(a), int(v[b, a]), 30) for m in (1, 2) for b, a in zip(y, x, strict=True)], "mask_id long, y int, x int, v int, height int")
    hulls = spark.createDataFrame([(1, [(0, 0), (7, 7), (0, 7)])], "mask_id long, hull array<struct<x:bigint,y:bigint>>")
    got = {(r.mask_id, r.y, r.x): r.v for r in masks.trim_to_mask(pixels, hulls, 40).collect()}
    assert len(got) == 2400 and all(got[2, b, a] == v[b, a] for b, a in zip(y, x, strict=True))
    # All of the first ten in raster order over the side by over half a cell and its ramp are white.
    far = [(b, a) for b, a in zip(y.tolist(), x.tolist(), strict=True) if ((a + 0.5) / 5 - (b + 0.5) / 3.75) / 2**0.5 > 0.675]
    assert {k for k in zip(y.tolist(), x.tolist(), strict=True) if got[1, *k] != v[k]} == set(far[:10]) and all(got[1, *k] == 255 for k in far[:10])


def test_stretch_reads_texts_as_runs(spark):
    plan = planned(spark, "ra18_white_stretch")
    # Texts to runs in both uses of one exchange, counts, pixels; before, rows of pixels were passed to tasks' code again.
    assert plan.count("MapInArrow") == 4 and "cast(v" not in plan


def test_corners_are_rounded_in_runs(spark):
    plan = planned(spark, "ra28_round_corners")
    assert plan.count("MapInArrow") == 2 and "SQRT" not in plan.upper()


def test_footprints_are_counted_in_runs(spark):
    plan = planned(spark, "tr13_valid_footprint")
    # Aggregates get sums of tasks, a row a scan, and no pixels.
    assert plan.count("MapInArrow") == 2 and "COS(" not in "".join(line for line in plan.upper().splitlines() if "AGGREGATE" in line)


def test_images_are_packed_from_runs(spark):
    from platen.sources import images
    from platen.sources.derived import Views

    v = Views(spark, SF)
    made = images.packed_pixels(v("pixel_runs"), "scan_id", 80)
    assert plan_of(made).count("MapInArrow") == 2
    rows = [(2, 0, x, x) for x in range(80)] + [(2, 1, x, 7) for x in range(79)] + [(1, 0, 0, 5)]
    got = images.packed_pixels(spark.createDataFrame(rows, "scan_id long, y int, x int, v int"), "scan_id", 80).collect()
    assert [(r.name, r.height, bytes(r.data)) for r in got] == [("2.png", 1, bytes(range(80)))]
