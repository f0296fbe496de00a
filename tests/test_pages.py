import pytest
from pyspark.sql import functions as F

from lodestone.operators import pages

BLOCK = "doc_id long, page int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, size double, bold_share double"
TABLE = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"


def block(doc, page, y0, text, x0=50.0, x1=550.0, high=20.0, size=10.0, bold=0.0):
    return (doc, page, 600.0, 800.0, x0, y0, x1, y0 + high, text, size, bold)


def made(spark, rows, **more):
    return {r.doc_id: r for r in pages.assemble(spark.createDataFrame(rows, BLOCK), **more).collect()}


def test_scopes_override_by_what_they_have(spark):
    df = spark.createDataFrame([(("text", None, 50, "evil"), (None, 1.25, None, "evil")), (None, None), ((None, None, None, "x"), ("lines", None, 7, "x"))], "app struct<pdf_table_strategy:string,pdf_heading_size_sensitivity:double,pdf_min_doc_length:int,other:string>, collection struct<pdf_table_strategy:string,pdf_heading_size_sensitivity:double,pdf_min_doc_length:int,other:string>")
    got = df.select(*[c.alias(n) for n, c in pages.overrides(F.col("app"), None, F.col("collection")).items()]).collect()
    assert [tuple(r) for r in got] == [("text", 1.25, 50), ("lines", 1.15, 100), ("lines", 1.15, 7)]
    assert [tuple(r) for r in df.limit(1).select(*pages.overrides().values()).collect()] == [("lines", 1.15, 100)]


def test_zones_only_cut_where_something_repeats(spark):
    calm = [block(1, p, 12.0, f"Question {p}") for p in range(1, 6)] + [block(1, p, 300.0, "body " * 20) for p in range(1, 6)]
    busy = [block(2, p, 10.0, "Unit  9\nof it") for p in range(1, 6)] + [block(2, p, 34.0, f"strip {p}") for p in range(1, 6)] + [block(2, p, 770.0, "foot") for p in (1, 2, 3)] + [block(2, p, 300.0, "Unit 9 of it" if p == 5 else "body " * 20) for p in range(1, 6)]
    two = [block(3, p, 10.0, "twice") for p in (1, 2)] + [block(3, 1, 300.0, "body " * 30)]
    got = {r.doc_id: r for r in pages.profile(spark.createDataFrame(calm + busy + two, BLOCK)).collect()}
    assert (got[1].header_zone, got[1].footer_zone, got[1].running) == (0.0, 1.0, [])
    assert (round(got[2].header_zone, 6), round(got[2].footer_zone, 6), got[2].running) == (34 / 800, 0.9575, ["Unit 9 of it"])
    assert (got[3].header_zone, got[3].running) == (0.0, [])
    out = made(spark, calm + busy + two)
    assert out[1].text.startswith("Question 1\n\nbody") and "twice" in out[3].text
    assert "Unit" not in out[2].text and "foot" not in out[2].text and "strip 1" in out[2].text  # it begins where the zone ends
    assert [p.page for p in out[2].pages] == [1, 2, 3, 4, 5]


def test_headings_and_pages_point_into_the_text(spark):
    rows = []
    for p in range(1, 7):
        rows += [block(1, p, 100.0, f"Part {p}", size=20.0), block(1, p, 200.0, "Chapter", size=15.0), block(1, p, 300.0, f"Bold opening {p}\nand more", bold=0.9), block(1, p, 400.0, "12345", size=30.0), *(block(1, p, 500.0 + 30 * i, "\x07plain " * 8) for i in range(4)), block(1, p, 790.0, str(40 + p), high=8.0)]
    rows.append(block(1, 7, 300.0, "   "))
    r = made(spark, rows)[1]
    at = {h.text: h for h in r.headings}
    assert all(r.text[h.pos :].startswith(h.text) for h in r.headings)
    assert [h.text for h in r.headings].count("Chapter") == 1 and at["Part 3"].level == 1 and at["Chapter"].level == 2 and at["Bold opening 2"].level == 2 and "12345" not in at
    assert [(p.page, p.logical) for p in r.pages] == [(p, 40 + p) for p in range(1, 7)]
    assert all(r.text[p.off :].startswith(f"Part {p.page}") for p in r.pages) and "\x07" not in r.text


def test_tables_stand_in_their_place_and_columns_in_order(spark):
    rows = [block(1, 1, 100.0 + 50 * i, f"left {i} " * 5, x1=280.0) for i in range(4)] + [block(1, 1, 100.0 + 50 * i, f"right {i} " * 5, x0=320.0) for i in range(4)]
    rows += [block(1, 1, 60.0, "over both " * 3), block(1, 1, 155.0, "inside", x1=200.0, high=10.0)]
    tables = spark.createDataFrame([(1, 1, 50.0, 150.0, 280.0, 172.0, [["a", "b|c"], ["1", None]]), (1, 1, 320.0, 300.0, 550.0, 320.0, [["one row"]])], TABLE)
    text = made(spark, rows, tables=tables)[1].text.split("\n\n")
    assert text[0].startswith("over both") and text[1].startswith("left 0") and text[2] == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert [t[:7].strip() for t in text[3:]] == ["left 2", "left 3", "right 0", "right 1", "right 2", "right 3"]


def test_short_documents_and_empty_tables(spark):
    rows = [block(1, 1, 100.0, "short"), block(2, 1, 100.0, "short"), *(block(3, 1, 30.0 + i, "x " * 80) for i in range(2)), block(3, 1, 200.0, "large", size=12.0), *(block(4, 1, 30.0 + i, "y " * 80) for i in range(2)), block(4, 1, 200.0, "large", size=12.0), block(5, 1, 1.0, "")]
    settings = spark.createDataFrame([(1, None, 3), (4, 1.3, None)], "doc_id long, size_ratio_threshold double, min_doc_length int")
    out = made(spark, rows, settings=settings)
    assert (out[1].outcome, out[1].text, out[2].outcome, out[2].text) == ("ok", "short", "too_short", None) and 5 not in out
    assert [tuple(h) for h in out[3].headings] == [(324, 3, "large")]
    assert out[4].headings == []
    none = spark.createDataFrame([], BLOCK)
    assert pages.assemble(none).count() == 0 and pages.assemble(none, spark.createDataFrame([], TABLE)).count() == 0


@pytest.mark.parametrize("name", ["doc_id", "page"])
def test_blocks_without_a_place_are_left_out(spark, name):
    df = spark.createDataFrame([block(1, 1, 100.0, "x " * 80)], BLOCK)
    more = df.unionByName(df.withColumn(name, F.lit(None).cast(dict(df.dtypes)[name])))
    assert [r.doc_id for r in pages.assemble(more).collect()] == [1]
