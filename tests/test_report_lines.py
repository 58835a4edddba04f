"""Report lines: all but a group's first items stay in their tasks until they are sorted."""

from pyspark.sql import functions as F

from lintlake.operators import report

_ITEMS = "g string, file_path string, rule_no int, fact_no int, cap_no int, text string"


def test_equal_items_and_equal_places(spark):
    rows = [
        ("a", "f", 1, 0, 0, "y"),
        ("a", "f", 1, 0, 0, "x"),
        ("a", "f", 1, 0, 0, "x"),
        ("a", "f", 2, 0, 0, "z"),
        ("a", "f", 2, 0, 0, "z"),
        ("b", None, 1, 0, 0, "n"),
        ("b", "f", 1, 0, 0, "m"),
    ]
    items = spark.createDataFrame(rows, _ITEMS)
    lines = report._listed(items, ["g"], 3)
    assert "LeftAnti" in lines._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.g, r.rule_no, r.lead + r.text) for r in lines.collect())
    assert got == [
        ("a", 1, ",x"),
        ("a", 1, ",y"),
        ("a", 1, "x"),
        ("a", 2, ",z"),
        ("a", 2, ",z"),
        ("b", 1, ",m"),
        ("b", 1, "n"),
    ]
    whole = report._listed(items.drop("g"), [], 3)
    assert [r.text for r in whole.where("lead = ''").collect()] == ["n"]
    assert whole.count() == 7
    assert report._listed(items.where(F.lit(False)), [], 3).count() == 0
