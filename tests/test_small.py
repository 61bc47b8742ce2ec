"""Operators that no query shows by themselves."""

from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import align, boilerplate, cluster, report
from driftline.sources import files

SECS = "pair_id string, role string, seq long, number string, title string, content string, page string"


def test_markers_names_and_item_texts(spark):
    df = spark.createDataFrame([("a <!-- table_page = 7 --> <!-- page 9 -->", "b", "c", ""), ("none", "", None, "s")], "t string, base_content string, compare_content string, diff_summary string")
    got = df.select(tx.page_marker(F.col("t")).alias("p"), cluster.item_text().alias("x")).collect()
    assert [(r.p, r.x) for r in got] == [("7", "b c"), ("", "s")]
    assert files.names_of("/x/20260101_base_vs_other_one/") == ("base", "other_one") and files.names_of("/x/y") == ("base", "compare")
    assert files.run_folder("out", "20260101", "my base", "c") == "out/20260101_my_base_vs_c"


def test_an_empty_side_matches_nothing(spark):
    secs = spark.createDataFrame([("p", "base", k, str(k), f"title {k}", "text", "1") for k in range(3)], SECS)
    for role in ("base", "compare"):
        matched, base, compare = align.align(secs.withColumn("role", F.lit(role)))
        assert (matched.count(), base.count(), compare.count()) == (0, 3 * (role == "base"), 3 * (role == "compare"))


def test_boilerplate_sections_go_before_alignment(spark):
    secs = spark.createDataFrame([("p", "base", 0, "1", "Table of contents", "x", "1"), ("p", "base", 1, "2", "Timing", "y", "1")], SECS)
    on = boilerplate.Boilerplate(enabled=True)
    assert [r.seq for r in boilerplate.filter_sections(secs, on).collect()] == [1] and boilerplate.filter_sections(secs, boilerplate.Boilerplate()).count() == 2


def test_chosen_tables_and_empty_reports(spark):
    kind = "doc_id string, table_index int, accuracy double"
    scored, simple = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 95.0)], kind), spark.createDataFrame([("a", 1, None), ("b", 1, None)], kind)
    assert sorted((r.doc_id, r.table_index, r.low_accuracy) for r in files.choose_tables(scored, simple).collect()) == [("a", 1, True), ("a", 2, False), ("b", 1, False)]
    rows = spark.createDataFrame([], "llm_result struct<diffs:array<struct<type:string,impact:string>>,summary:string>, pair_id string, item_id int")
    assert report.abstract(rows).startswith("0 differences in 0 of 0 sections")
