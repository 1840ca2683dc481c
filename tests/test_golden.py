"""Known values and invariants of single operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.operators import edges, frames, layout, masks, parts, pixels, proposals, scale
from platen.sources import scans
from platen.streaming import state


def cells(spark, text):
    return spark.createDataFrame([(0, y, x) for y, row in enumerate(text.split()) for x, c in enumerate(row) if c == "#"], "mask_id long, y int, x int")


def test_preset_fit_turns_and_caps(spark):
    c = spark.createDataFrame([(100, 200, None, "preset", 125.0, 88.0, None, None, 0.0)], "w_px int, h_px int, mm_per_px double, fit string, preset_w double, preset_h double, sheet_w double, sheet_h double, margin_mm double")
    r = layout.plan_layout(c).first()
    assert (r.note_code, r.content_w, r.content_h) == (1, 44.0, 88.0)


def test_components_are_numbered_in_raster_order(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    text = "............ .##......... .##......... .##....##... .......##... .......##..."
    got = parts.connected_components(cells(spark, text), 12).groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y")).orderBy("label").collect()
    assert [(r.label, r.n, r.x, r.y) for r in got] == [(1, 6, 1, 1), (2, 6, 7, 3)]


def test_hull_bridges_two_blocks_and_never_shrinks(spark):
    rows = ["................"] * 3 + ["..####....####.."] * 10 + ["................"] * 3
    on = cells(spark, " ".join(rows))
    clean = masks.clean_mask(on, masks.convex_hull(on))
    assert clean.count() == 12 * 10 and on.join(clean, ["mask_id", "y", "x"], "left_anti").count() == 0


def test_least_rectangle_of_a_rectangle(spark):
    r = masks.min_area_rect(masks.convex_hull(cells(spark, "...... .####. .####. ......"))).first()
    assert (round(r.cx, 6), round(r.cy, 6), round(max(r.w, r.h), 6), round(min(r.w, r.h), 6)) == (2.5, 1.5, 3.0, 1.0)


def test_turned_mask(spark):
    c = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 3), (0, 1, 1, 4)], "mask_id long, y int, x int, v int")
    t = frames.turn_cells(c, F.lit(2), F.lit(2), F.lit(1)).orderBy("y", "x").collect()
    assert [r.v for r in t] == [3, 1, 4, 2]


def test_four_quarter_turns_are_none(spark):
    b = spark.createDataFrame([(0.1, 0.2, 0.7, 0.9)], "x0 double, y0 double, x1 double, y1 double")
    t = b
    for _ in range(4):
        t = frames.turn_box(t.withColumn("k", F.lit(1))).select("x0", "y0", "x1", "y1")
    assert np.allclose(t.first(), b.first())


def test_sleeve_and_page_group_and_another_stays_apart(spark):
    c = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.7, 0.7, 0.97), (1, 2, 0.4, 0.5, 0.35, 0.65, 0.96), (1, 3, 0.1, 0.1, 0.2, 0.2, 0.9)], "scan_id long, cand_id long, cx double, cy double, w double, h double, score double")
    got = {r.cand_id: (r.group_no, r.rank) for r in proposals.group_candidates(c).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (1, 0)}


def test_two_cards_share_a_page(spark):
    items = spark.createDataFrame([(1, k, 0, 85.6, 54.0, False, 210.0, 297.0, 10.0) for k in (1, 2)], "sheet_id long, item_no long, layout_id int, nat_w double, nat_h double, fill boolean, sheet_w double, sheet_h double, margin_mm double")
    got = layout.arrange(items).orderBy("item_no").collect()
    assert [r.arrangement for r in got] == ["column", "column"] and all(r.x + r.w / 2 == pytest.approx(105, abs=0.1) for r in got)
    assert (got[0].y + got[1].y + got[1].h) / 2 == pytest.approx(148.5, abs=0.1)


def test_three_spreads_need_more_pages(spark):
    items = spark.createDataFrame([(1, k, 125.0, 176.0, 190.0, 277.0, 10.0) for k in range(3)], "sheet_id long, item_no long, w double, h double, avail_w double, avail_h double, gap double")
    assert layout.shelf_pack(items).agg(F.count_distinct("page")).first()[0] == 3


def test_known_skew_is_recovered(spark):
    y, x = np.mgrid[0:300, 0:400]
    rows = [(int(10 * k), int(a), int(b), 300) for k in (-3.1, 0.0, 2.0) for a, b in zip(*np.nonzero(((y - np.tan(np.radians(k)) * x) % 40) < 2), strict=True)] + [(99, k, k, 300) for k in range(150)]
    ink = spark.createDataFrame(rows, "scan_id long, y int, x int, height int")
    for band in (512, 40):
        got = {r.scan_id: r.skew for r in pixels.estimate_skew(ink, 400, band=band).collect()}
        assert got[99] == 0.0 and all(abs(got[10 * k] - k) <= 0.3 for k in (-3.1, 0.0, 2.0) for k in [k] if int(10 * k) in got and int(10 * k) == 10 * k)


def test_unknown_scale_stays_null(spark):
    s = spark.createDataFrame([(1, 100, 100, None, 2, 200.0, 200.0), (2, 100, 100, 300.0, 2, 200.0, 200.0), (3, 100, 100, 10.0, 2, 200.0, 200.0)], "scan_id long, width_px int, height_px int, header_dpi double, dpi_unit int, page_w_pt double, page_h_pt double")
    got = {r.scan_id: r.w_mm for r in scale.measured_px(s).collect()}
    assert got == {1: None, 2: 8.5, 3: None}


def test_refined_line_is_found_between_pixels(spark):
    """A soft edge along 2.37 + 0.013 t, with outliers, seen at every quarter pixel; sides seen at few places have no line."""
    rows = []
    for side, places in ((0, 60), (1, 60), (2, 15)):
        for k in range(places):
            t = float(2 * k - places)
            edge = 2.37 + 0.013 * t - (0.5 + 0.01 * t) + (1.5 if k % 9 == 0 else 0.0)
            for n in range(25):
                d = n * 0.25 - 3
                g = 40 * np.exp(-((d - edge) ** 2) / 2)
                rows.append((1, side, t, d, 0.5 + 0.01 * t, float(g), float(g / 2), 1.0, side != 1 or k % 3 == 0))
    s = spark.createDataFrame(rows, "scan_id long, side int, t double, d double, base double, gr double, gg double, gb double, ok boolean")
    got = {r.side: r for r in edges.refine_line(s).collect()}
    assert set(got) == {0} and abs(got[0].a - 2.37) < 0.05 and abs(got[0].b - 0.013) < 1e-3 and got[0].sd == pytest.approx(0.3)


def test_closing_contains_the_mask(spark):
    on = cells(spark, "#..#.... ..#..... .....##. ........ #....... ...##... ..#..#.. .......#")
    closed = masks.morphology(masks.dense(on, 8), "close", 1).where("v = 1")
    assert on.join(closed, ["mask_id", "y", "x"], "left_anti").count() == 0


def test_golden_corpus_is_read(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": 1, "render_dpi": 300, "model": "m", "fixtures": [{"id": "a", "visibility": "public", "page_mm": [216.0, 297.0], "expected": {"skew_degrees": -2.4}}]}')
    r = scans.read_corpus(spark, str(tmp_path / "c.json")).first()
    assert (r.id, r.page_w_mm, r.page_h_mm, r.expected.skew_degrees) == ("a", 216.0, 297.0, -2.4)


def test_turning_and_turning_back_keeps_flat_areas(spark):
    p = spark.createDataFrame([(1, y, x, 100, 20) for y in range(20) for x in range(20)], "scan_id long, y int, x int, v int, height int")
    r = pixels.rotate_fine(p, F.lit(3.0), 20).where("y between 5 and 14 and x between 5 and 14")
    assert r.where("abs(v - 100) > 1e-6").count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k % 3, k, "a" if k % 2 else "b", 10.0 * k) for k in range(40)]
    batch = spark.createDataFrame(rows, "run_id long, event_id long, key string, ms double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    touches = stream.select(F.col("run_id").alias("doc_id"), "ts").withWatermark("ts", "1 day")
    q = state.sessions(touches).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    own = state.sessions(batch.select(F.col("run_id").alias("doc_id"), "ts"))
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, own.collect()))

    state.upsert(stream, str(tmp_path / "state"), ["run_id", "key"], ["ts", "event_id"], str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "state/version=0"))
    assert sorted((r.run_id, r.key, r.ms) for r in kept.collect()) == sorted((r.run_id, r.key, r.ms) for r in state.latest_state(batch, ["run_id", "key"], ["ts", "event_id"]).collect())


def test_outline_of_a_tilted_mask_follows_its_sides(spark):
    y, x = np.mgrid[0:64, 0:64]
    a = np.radians(8.0)
    u, w = (x + 0.5 - 32) * np.cos(a) + (y + 0.5 - 32) * np.sin(a), (y + 0.5 - 32) * np.cos(a) - (x + 0.5 - 32) * np.sin(a)
    on = (abs(u) <= 20) & (abs(w) <= 14)
    ys, xs = np.nonzero(on)
    c = spark.createDataFrame([(1, int(p), int(q)) for p, q in zip(ys, xs, strict=True)], "mask_id long, y int, x int")
    r = masks.outline_quad(c, 64).first()
    for k, (sx, sy) in enumerate([(-20, -14), (20, -14), (20, 14), (-20, 14)]):
        assert abs(r[f"x{k}"] - (32 + sx * np.cos(a) - sy * np.sin(a))) < 1.2 and abs(r[f"y{k}"] - (32 + sx * np.sin(a) + sy * np.cos(a))) < 1.2


def test_rectangle_is_refined_to_the_edges_around_it(spark):
    rows = [(1, y, x, (40 if 30 <= x < 90 and 20 <= y < 60 else 220) + (x * 7 + y * 3) % 5) for y in range(80) for x in range(120)]
    p = spark.createDataFrame(rows, "scan_id long, y int, x int, v int")
    r = spark.createDataFrame([(1, 61.0, 39.0, 56.0, 37.0, 0.0)], "scan_id long, cx double, cy double, w double, h double, angle double")
    got = pixels.refine_rect(p, r, prominence=2.0).first()
    assert abs(got.w - 60) <= 1.5 and abs(got.h - 40) <= 1.5 and abs(got.cx - 60) <= 1.5 and abs(got.cy - 40) <= 1.5


def card_raster(spark, width, height, radius):
    """A dark card with rounded corners that fills a white frame."""
    y, x = np.mgrid[0:height, 0:width] + 0.5
    dx, dy = np.maximum(np.maximum(radius - x, x - (width - radius)), 0), np.maximum(np.maximum(radius - y, y - (height - radius)), 0)
    v = np.where(np.hypot(dx, dy) <= radius, 40, 250)
    return spark.createDataFrame([(1, int(r), int(c), int(v[r, c]), height) for r in range(height) for c in range(width)], "scan_id long, y int, x int, v int, height int")


@pytest.mark.parametrize("radius", [9.0, 12.0])
def test_corner_radii_of_a_round_card_are_found(spark, radius):
    card = card_raster(spark, 90, 60, radius)
    got = {r.corner: r.radius for r in pixels.corner_radii(card, card.select("scan_id", "height").distinct(), 90, 10.0).collect()}
    assert set(got) == {0, 1, 2, 3} and all(abs(r - radius) <= 1 for r in got.values())


def test_frames_without_room_for_an_arc_keep_the_standard_radius(spark):
    card = card_raster(spark, 90, 6, 1)
    got = pixels.corner_radii(card, card.select("scan_id", "height").distinct(), 90, 10.0).collect()
    assert sorted((r.corner, r.radius) for r in got) == [(k, 10.0) for k in range(4)]


def test_warp_of_the_whole_frame_is_the_frame_and_a_flat_quad_is_white(spark):
    frame = card_raster(spark, 20, 12, 4).drop("height")
    corners = "scan_id long, w_px int, h_px int, out_w int, out_h int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"
    whole = spark.createDataFrame([(1, 20, 12, 20, 12, 0.0, 0.0, 20.0, 0.0, 20.0, 12.0, 0.0, 12.0)], corners)
    assert sorted(map(tuple, pixels.warp_quad(frame, whole).select("scan_id", "y", "x", "v").collect())) == sorted(map(tuple, frame.collect()))
    flat = spark.createDataFrame([(1, 20, 12, 3, 2, 0.0, 0.0, 5.0, 0.0, 10.0, 0.0, 15.0, 0.0)], corners)
    assert [r.v for r in pixels.warp_quad(frame, flat).collect()] == [255] * 6
