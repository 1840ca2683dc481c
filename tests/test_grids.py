"""Cases of a review: rasters of texts stay runs up to the result, bands are worked out as grids, and tasks add up what no other task has."""

from functools import partial
from math import ceil, hypot

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def planned(spark, name):
    from platen.plans import catalog

    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scans(spark):
    """Rasters with a short last row, as runs of whole rows, and cut in two, which makes no grid."""
    from platen.operators import bands

    rng = np.random.default_rng(4)
    images = {k: np.where(np.arange(w * h).reshape(h, w) < w * (h - 1) + short, rng.integers(0, 256, (h, w)), -1) for k, (h, w, short) in enumerate([(23, 16, 16), (41, 16, 5), (1, 16, 9), (2, 16, 1), (70, 16, 15), (30, 11, 7)])}
    rows = pd.DataFrame([(k, y, x, int(p[y, x]), p.shape[0]) for k, p in images.items() for y, x in np.ndindex(p.shape) if p[y, x] >= 0], columns=["scan_id", "y", "x", "v", "height"])
    df = spark.createDataFrame(rows)
    cut = bands.runs(df.where("x < 7").coalesce(1), keep=("height",)).unionByName(bands.runs(df.where("x >= 7").coalesce(1), keep=("height",)))
    return rows, bands.runs(df.coalesce(1), keep=("height",)).cache(), cut.cache()


def same(a, b, keys=("scan_id", "y", "x")):
    a, b = (d.toPandas().sort_values(list(keys), ignore_index=True) for d in (a, b))
    assert len(a) == len(b) > 0 and all(np.allclose(a[c], b[c], equal_nan=True) for c in a.columns)


RUNS = ["ra17_clahe", "ra5_gradient_profiles", "ra6_snap_edges", "tr5_rotate_fine", "ra12_median9", "ra2_box_mean", "tr9_warp_quad", "ra24_trim_to_outline", "ra3_ink_points", "ra9_gaussian_blur"]


@pytest.mark.parametrize("name", RUNS)
def test_texts_stay_runs_up_to_the_result(spark, name):
    # Texts to runs, and runs to the result; before, rows of pixels were passed from task to task between.
    assert planned(spark, name).count("MapInArrow") == 2


def lines(seed, h, w, slope):
    """Dark lines, of which every row has its share, on a light ground."""
    y, x = np.mgrid[0:h, 0:w]
    v = np.where((y - slope * x) % 9 < 2, 40, 230) + np.random.default_rng(seed).integers(0, 9, (h, w))
    return [(seed, int(a), int(b), int(v[a, b]), h) for a, b in np.ndindex(v.shape)]


def test_skew_is_projected_where_ink_is_found(spark):
    plan = planned(spark, "ra4_estimate_skew")
    # Texts to runs, and runs to a scan's best angle: neither points of ink nor changes by row are exchanged between.
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_bands_of_a_skewed_page_add_up(spark):
    from platen.operators import pixels

    rows = lines(1, 300, 60, 0.05) + lines(2, 120, 60, -0.03) + lines(3, 9, 60, 0.0)
    page = spark.createDataFrame(rows, "scan_id long, y int, x int, v int, height int")
    got = [{r.scan_id: r.skew for r in pixels.page_skew(page, 60, band=b).collect()} for b in (None, 64, 32)]
    assert got[0] == got[1] == got[2] and abs(got[0][1] - np.degrees(np.arctan(0.05))) < 0.3 and abs(got[0][2] + np.degrees(np.arctan(0.03))) < 0.3
    ink = pixels.ink_points(page, 60)
    assert got[0] == {r.scan_id: r.skew for r in pixels.estimate_skew(ink, 60, band=40).collect()}


@pytest.mark.parametrize("cuts", [(), (20,), (13, 26, 39)])
def test_projections_of_parts_are_those_of_the_whole(cuts):
    from platen.operators import pixels

    h, w, rng = 50, 30, np.random.default_rng(len(cuts))
    y, x = np.nonzero(rng.random((h, w)) < 0.3)
    n, want = ceil(hypot(w, h)) + 2, np.zeros(101)
    for k, t in enumerate(range(-50, 51)):
        a = np.radians(t / 10)
        at = -x * np.sin(a) + y * np.cos(a) + (n / 2 - (w * abs(np.sin(a)) + h * np.cos(a)) / 2)
        bins = np.zeros(n + 4)
        for p in at:
            bins[int(np.floor(p))] += 1 - (p - np.floor(p))
            bins[int(np.floor(p)) + 1] += p - np.floor(p)
        change = [0.25 * (bins[r + 1] + bins[r] - bins[r - 1] - bins[r - 2]) for r in range(2, n - 1)]
        want[k] = np.sum(np.square(change))
    got, shared = np.zeros(101), {}
    ends = [0, *cuts, h]
    for top, below in zip(ends, ends[1:], strict=False):
        own = (y >= top) & (y < below)
        squares, _, turn, row, change = pixels.projected(x[own].astype(float), y[own].astype(float), h, top, below, w, 50)
        got += squares
        for t, r, c in zip(turn.tolist(), row.tolist(), change.tolist(), strict=True):
            shared[t, r] = shared.get((t, r), 0.0) + c
    assert bool(shared) == bool(cuts)
    for (t, _), c in shared.items():
        got[t + 50] += c * c
    assert np.allclose(got, want)


def test_contrast_of_whole_scans_and_of_rows_of_tiles(scans, monkeypatch):
    from platen.operators import bands, pixels

    _, whole, cut = scans
    made = pixels.clahe(whole, 16, tiles=4).cache()
    monkeypatch.setattr(bands, "AT_ONCE", 1)
    # Rows of tiles with those around them; cells that are no grid.
    same(made, pixels.clahe(whole, 16, tiles=4))
    same(made, pixels.clahe(cut, 16, tiles=4))


@pytest.mark.parametrize("name", ["clahe", "median9", "box_mean", "gaussian_blur", "ink_points"])
def test_small_scans_are_dealt_without_copies(scans, monkeypatch, name):
    from platen.operators import bands, pixels

    dealt, given = [], bands._in_portions
    monkeypatch.setattr(bands, "_in_portions", lambda df, *a: dealt.append(df.count()) or given(df, *a))
    # There is no band before the first, and a small scan's rows of tiles are one band.
    getattr(pixels, name)(scans[1], *([16] if name in ("clahe", "ink_points") else []))
    assert dealt == [scans[1].count()]


@pytest.mark.parametrize("band", [7, 256])
@pytest.mark.parametrize("name", ["median9", "box_mean", "gaussian_blur", "sobel"])
def test_grids_give_what_cells_give(scans, monkeypatch, name, band):
    from platen.operators import bands, pixels

    monkeypatch.setattr(bands, "neighbouring", partial(bands.neighbouring, band=band))
    _, whole, cut = scans
    same(getattr(pixels, name)(whole), getattr(pixels, name)(cut))


def test_medians_by_levels_are_medians(scans):
    from platen.operators import pixels

    rows, whole, _ = scans
    got = pixels.median9(whole).toPandas().set_index(["scan_id", "y", "x"])["median"].to_dict()
    for k in (0, 1):
        own = rows[rows.scan_id == k]
        h = own.height.iloc[0]
        line = [own[own.y == y].sort_values("x").v.to_numpy() for y in range(h)]
        for y, x in [(0, 0), (5, 8), (h - 1, 3), (h - 2, 15), (h - 3, 9)]:
            last = h - 1 if len(line[h - 1]) > x else h - 2
            square = [line[min(max(b, 0), last)] for b in range(y - 4, y + 5)]
            assert got[k, y, x] == np.median([p[min(max(a, 0), len(p) - 1)] for p in square for a in range(x - 4, x + 5)])


def test_outlines_trim_grids_as_cells(spark, scans):
    from platen.operators import pixels

    outline = [(2.0, 1.0), (13.0, 3.0), (11.0, 30.0), (4.0, 20.0)]
    o = spark.createDataFrame([(0, outline), (1, outline), (4, outline[:2])], "scan_id long, outline array<struct<x:double,y:double>>")
    same(pixels.trim_to_outline(scans[1], o), pixels.trim_to_outline(scans[2], o))
    kept = pixels.trim_to_outline(scans[1], o).where("scan_id > 1").toPandas().sort_values(["scan_id", "y", "x"])["v"].tolist()
    assert kept == scans[0][scans[0].scan_id > 1].sort_values(["scan_id", "y", "x"])["v"].tolist()


def test_lines_of_profiles_are_added_up_by_tasks(spark, scans):
    from platen.operators import pixels

    rows, whole, cut = scans
    boxes = spark.createDataFrame([(k, 16, int(h), 1, 0, 15, int(h)) for k, h in rows.groupby("scan_id")["height"].first().items() if k != 1], "scan_id long, width int, height int, px0 int, py0 int, px1 int, py1 int")
    made = pixels.gradient_profiles(whole, boxes).withColumn("axis", F.ascii("axis"))
    same(made, pixels.gradient_profiles(cut, boxes).withColumn("axis", F.ascii("axis")), ("scan_id", "axis", "at"))
    got = {(r.scan_id, chr(r.axis), r["at"]): r.profile for r in made.collect()}
    p = rows[rows.scan_id == 4].pivot(index="y", columns="x", values="v").to_numpy()
    assert all(got[4, "x", x] == np.abs(p[17:53, x + 1] - p[17:53, x - 1]).sum() for x in range(1, 15)) and all(got[4, "y", y] == np.abs(p[y + 1, 4:12] - p[y - 1, 4:12]).sum() for y in range(1, 69))
    assert not any(k[0] == 1 for k in got)


def test_sides_and_lines_meet_once(spark):
    plan = planned(spark, "ra6_snap_edges")
    # Boxes meet the rows and then the lines: profiles were ranked, sides found and both joined apart.
    assert plan.count("Join") == 2 and plan.count("Exchange hashpartitioning") == 6


def test_snapped_sides(spark):
    from platen.operators import pixels

    v = np.full((40, 60), 200)
    v[10:31, 14:47] = 90
    p = spark.createDataFrame([(1, int(y), int(x), int(v[y, x])) for y, x in np.ndindex(v.shape)], "scan_id long, y int, x int, v int")
    box = spark.createDataFrame([(1, 60, 40, 16, 12, 44, 28), (2, 60, 40, 5, 6, 50, 30)], "scan_id long, width int, height int, px0 int, py0 int, px1 int, py1 int")
    # The first of equals is the strongest line; a scan without pixels keeps its box.
    assert sorted(map(tuple, pixels.snap_edges(p, box, 0.1, 0.5).collect())) == [(1, 13, 9, 46, 30), (2, 5, 6, 50, 30)]


def test_print_maps_shrink_to_runs(spark):
    plan = planned(spark, "ra13_print_map")
    # Texts to runs, to shrunk runs, to the map: no join with frames, no rows of pixels between.
    assert plan.count("MapInArrow") == 3 and "Join" not in plan


@pytest.mark.parametrize("joined", [True, False])
def test_print_map_of_shrunk_scans(spark, scans, joined):
    from platen.operators import bands, pixels

    rows, whole, cut = scans
    sizes = rows.groupby("scan_id").agg(width=("x", "max"), height=("height", "first")).reset_index()
    frames = spark.createDataFrame(pd.DataFrame({"scan_id": sizes.scan_id, "width": sizes.width + 1, "height": sizes.height, "angle": [2.0, -3.0, 0.0, 1.0, -1.0, 0.0]}))
    made = [pixels.print_map(p if joined else p.drop("height").join(frames, "scan_id"), frames if joined else None, longest=40, margin=1) for p in (whole, cut)]
    same(*made)
    # Scan 4 is shrunk to 40 rows by area averages, halves up.
    small = bands.averaged(whole.where("scan_id = 4"), {"sy": F.lit(40 / 70), "sx": F.lit(9 / 16), "rows": F.lit(40), "cols": F.lit(9)}, 1e-9, (), True)
    got = np.full((40, 9), -1.0)
    for r in bands.each_pixel(small, lambda v, _: v, "double", ()).collect():
        got[r.y, r.x] = r.v
    p = rows[rows.scan_id == 4].pivot(index="y", columns="x", values="v").to_numpy(float)
    for y, x in [(0, 0), (13, 4), (20, 8), (38, 2)]:
        down = [max(0.0, min((b + 1) * 40 / 70, y + 1) - max(b * 40 / 70, y)) for b in range(70)]
        across = [max(0.0, min((a + 1) * 9 / 16, x + 1) - max(a * 9 / 16, x)) for a in range(16)]
        w = np.outer(down, across) * np.isfinite(p)
        assert got[y, x] == np.floor((np.nan_to_num(p) * w).sum() / w.sum() + 0.5 + 1e-7)


def test_rasters_are_compared_as_runs(spark, scans):
    from platen.operators import pixels

    # Texts to runs thrice, which is done twice, counts, the stretched runs, and their differences; before, the stretched pixels were rows.
    assert planned(spark, "ra25_changed_fraction").count("MapInArrow") == 6
    rows, whole, cut = scans
    after = rows.assign(v=np.where(rows.index % 3 == 0, rows.v + 0.5, rows.v))[rows.index % 5 > 0]
    want = {k: (g.index % 3 == 0).mean() for k, g in after.groupby("scan_id")}
    for before in (whole, cut):
        got = {r.scan_id: r.changed for r in pixels.changed_fraction(before, spark.createDataFrame(after)).collect()}
        assert got == {k: want[k] for k in got} and set(got) == set(want)
    stretched = pixels.white_stretch(whole).toPandas().merge(rows, on=["scan_id", "y", "x"])
    want = {k: (g.v_x != g.v_y).mean() for k, g in stretched.groupby("scan_id")}
    for other in (whole, cut):
        assert {r.scan_id: r.changed for r in pixels.changed_fraction(whole, pixels.white_stretch(other, packed=True)).collect()} == want
