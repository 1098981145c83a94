"""Plans are what they are meant to be: no shuffle where a row is enough, filters
and columns at the scan."""

import os
import re

import pytest

from inkwell import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_words", "slug_lines", "label_value_ratio", "entropy_topk", "clamp_projection", "target_position", "shape_cost", "word_boxes", "forward_search", "key_title", "layout_spec", "gen_text"])
def test_no_shuffle(spark, name):
    """Where files have splits enough."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert "Exchange" not in plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_files_are_dealt_out(spark):
    assert plan(spark, "label_words").count("Exchange RoundRobinPartitioning") == 1


def test_few_customers_are_dealt_out(spark):
    """A text is much work for a row of a small file."""
    assert plan(spark, "gen_text").count("Exchange RoundRobinPartitioning") == 1


@pytest.mark.parametrize(("name", "columns"), [("mask_area", "doc_id:bigint,text:string"), ("running_page_counter", "o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string"), ("first_match", "conv_id:bigint,turn:bigint,role:string,text:string")])
def test_columns(spark, name, columns):
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))) == {columns}


def test_pushed_filters(spark):
    assert re.search(r"PushedFilters: \[[^\]]*In\(lang", plan(spark, "multi_filter_limit"))


def test_one_scan_of_cells(spark):
    """Both aggregates of the cells read one exchange."""
    df = catalog.queries()["pass_rates_by_config"](spark, SF)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "shuffles"), [("mask_area", 2), ("paint_max", 2), ("region_mean", 3)])
def test_no_pixels(spark, name, shuffles):
    """Boxes are shuffled by tile and what was painted by picture; rows are
    spread out over tiles only, never over pixels."""
    found = plan(spark, name)
    assert found.count("Exchange hashpartitioning") == shuffles
    spread = [x for x in found.splitlines() if "Generate explode(sequence(" in x]
    assert len(spread) == 2 and all("FLOOR" in x.upper() or "/ 64" in x or "/ 512" in x for x in spread)


@pytest.mark.parametrize("name", ["mask_area", "paint_max", "budget_map", "region_mean"])
def test_pictures_where_their_row_is(spark, name, monkeypatch):
    """Only large pictures are shuffled, with the same results."""
    from inkwell.plans import geometry

    df = catalog.queries()[name](spark, SF)
    rows = sorted(df.collect())
    found = df._jdf.queryExecution().executedPlan().toString()
    assert found.count("MapInArrow") >= 2 and len(re.findall(r"Filter \(.*length\(text#\d+\), 0\) <= 524288", found)) >= 1
    monkeypatch.setattr(geometry, "WHOLE_CHARS", -1)
    assert sorted(catalog.queries()[name](spark, SF).collect()) == rows and rows


def test_headers_where_their_row_is(spark):
    found = plan(spark, "section_headers")
    assert "Join" not in found and "Exchange hashpartitioning" not in found and "Python" not in found


@pytest.mark.parametrize("name", ["importance_pipeline", "blank_entropy", "salience_map", "masked_scores"])
def test_scores_where_their_picture_is(spark, name):
    found = plan(spark, name)
    assert "Window" not in found and "Join" not in found and "Exchange hashpartitioning" not in found
    assert found.count("Scan parquet") == 1
