"""Cases of a review: steps whose time grew faster than their rows."""

import numpy as np

SF = "/root/testdata/sf0.001"


def test_windows_to_the_next_insertion_grow(spark):
    from platen.plans import catalog

    # A frame that ends at the partition's last row is read again for each of its rows.
    plan = catalog.QUERIES["st1_held_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing$(), " not in plan and ", unboundedfollowing$()" not in plan and "unboundedpreceding$(), -1" in plan


def test_an_hour_of_many_insertions(spark):
    from datetime import datetime, timedelta

    from platen.streaming import keyed

    t0 = datetime(2024, 1, 1)
    rows = [(k % 50, k, t0 + timedelta(seconds=k % 7200, microseconds=k % 3), k % 3 == 0) for k in range(6000)]
    got = {r.event_id: r.reaped for r in keyed.next_insertion(spark.createDataFrame(rows, "doc_id long, event_id long, ts timestamp, inserted boolean"), timedelta(minutes=10)).collect()}
    inserted = np.array(sorted(r[2] for r in rows if r[3]))
    for _, k, ts, _ in rows:
        at = np.searchsorted(inserted, ts + timedelta(minutes=10), "right")
        assert got[k] == (inserted[at] if at < len(inserted) else None)


def test_few_and_many_groups_are_the_same(spark, monkeypatch):
    from platen.operators import proposals

    rng = np.random.default_rng(5)
    boxes = rng.random((300, 4)) * (0.6, 0.6, 0.2, 0.2) + (0.2, 0.2, 0.05, 0.05)
    found = []
    for few in (0, 40, 10_000):
        monkeypatch.setattr(proposals, "FEW", few)
        groups = proposals.Groups()
        found.append([groups.place(*b, lambda shared, _: shared >= 0.3) for b in boxes.tolist()])
        assert bool(groups.at) == (few < 10_000)
    assert found[0] == found[1] == found[2] and max(g for g, _ in found[0]) > 40


def test_votes_keep_their_columns_without_a_join(spark):
    from platen.plans import catalog

    assert "Join" not in catalog.QUERIES["gr11_vote_groups"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_points_of_sides_are_not_rows(spark):
    from pyspark.sql import functions as F

    from platen.operators import edges
    from platen.plans import catalog

    assert "sequence(0, 299" not in catalog.QUERIES["ft1_side_samples"](spark, SF)._jdf.queryExecution().optimizedPlan().toString() and hasattr(edges, "side_extents")
    q = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 3.0, 38.0, 30.0, -2.0, 31.0)], "scan_id long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    got = {r.side: r for r in edges.side_extents(q, 7).collect()}
    for k in range(4):
        side = q.select("scan_id", *(F.col(f"{c}{i}").alias(f"{c}{e}") for e, i in (("a", k), ("b", (k + 1) % 4)) for c in "xy"))
        p = edges.side_samples(side, 7).toPandas()
        assert got[k].n == len(p) == 7 and np.allclose([got[k][c] for c in ("x0", "x1", "y0", "y1", "mx", "my")], [p.x.min(), p.x.max(), p.y.min(), p.y.max(), p.x.mean(), p.y.mean()])
