"""Sections of a report that nobody asks for are not worked out."""

import __spark_entry__ as entry_module

plan_of = lambda spark, name: entry_module.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_counted_sections_have_no_texts(spark):
    assert "nfkd_ascii" not in plan_of(spark, "rp1_sections_per_alert")


def test_sections_left_out_are_not_rendered(spark):
    assert "RAW EXTRACTED TEXT" not in plan_of(spark, "rp1_render_report")
