"""Cases of a review: memory of a task that grew with the rows of the table."""

import pytest

SF = "/root/testdata/sf0.001"


def planned(spark, monkeypatch, name, each):
    from platen.plans import catalog
    from platen.sources import derived

    monkeypatch.setitem(derived.SPREAD, "line_rows", (("l_orderkey",), each))
    made = catalog.QUERIES[name](spark, SF)
    return made, made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ly7_natural_sizes", "ly10_sheet_facts"])
def test_sheets_are_dealt_once_by_the_count_of_rows(spark, monkeypatch, name):
    rows, found = spark.read.parquet(f"{SF}/lineitem.parquet").count(), []
    for each in (rows // 2, 1000):
        made, plan = planned(spark, monkeypatch, name, each)
        assert plan.count("Exchange hashpartitioning") == 1 and made.rdd.getNumPartitions() == -(-rows // each)
        found.append(sorted(map(tuple, made.collect())))
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["ly8_arrange", "snk1_write_placements"])
def test_one_sort_serves_all_windows_of_an_arrangement(spark, monkeypatch, name):
    _, plan = planned(spark, monkeypatch, name, 1000)
    # The lines' own, the one by sheet for natural sizes, the one by sheet and item for the rest.
    assert plan.count("- Sort [") == 3 and plan.count("Exchange hashpartitioning") == 1


def test_pages_go_by_layout_and_item(spark):
    from platen.operators import layout

    rows = [(1, lay, k, 5.0 * k, 7.0, 85.6, 54.0, 297.0) for k in (2, 1) for lay in (1, 0)]
    p = spark.createDataFrame(rows, "sheet_id long, layout_id int, item_no long, x double, y double, w double, h double, page_h double")
    got = {(r.layout_id, r.item_no): r.page_no for r in layout.placements_pt(p).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4}
