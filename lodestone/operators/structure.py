"""Headings, section paths and pages of documents, and page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def headings(text: Column | str) -> Column:
    """Markdown headings as an array of (pos, level, text) in order; pos is the offset of the line."""
    lines = F.split(col(text), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,level:int,text:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1)
        here = F.array(F.struct(acc["at"].alias("pos"), F.length(marks).alias("level"), F.trim(F.regexp_extract(line, r"^#{1,6}[ \t]+(.*)$", 1)).alias("text")))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(marks != "", F.concat(acc["found"], here)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(lines, start, step, lambda acc: acc["found"])


def section_path(heads: Column | str, at: Column | str) -> Column:
    """The headings in force at an offset, outermost first: each heading ends those of its own and deeper levels."""
    before = F.filter(col(heads), lambda h: h["pos"] <= col(at))
    none = F.array().cast("array<struct<pos:int,level:int,text:string>>")
    open_ = F.aggregate(before, none, lambda acc, h: F.concat(F.filter(acc, lambda x: x["level"] < h["level"]), F.array(F.struct(h["pos"].alias("pos"), h["level"].alias("level"), h["text"].alias("text")))))
    return F.transform(open_, lambda h: h["text"])


def page_at(pages: Column | str, at: Column | str) -> Column:
    """The last entry of an array of (off, ...) at or before an offset; the first if all lie behind it."""
    own = F.filter(col(pages), lambda p: p["off"] <= col(at))
    return F.coalesce(F.try_element_at(own, F.lit(-1)), F.get(col(pages), F.lit(0)))


def gutters(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) from blocks (doc_id, page, page_width, x0, x1): the middle of the widest gap between
    neighbouring block centres, if it has 15 % of the page's width, and three blocks lie on either side; else null."""
    page = ["doc_id", "page"]
    centre = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy(*page).orderBy("c")
    own = blocks.withColumn("c", centre)
    own = own.withColumns({"before": F.lag("c").over(w), "rank": F.row_number().over(w)})
    widest = F.max(F.struct((F.col("c") - F.col("before")).alias("gap"), (-F.col("rank")).alias("left"), ((F.col("c") + F.col("before")) / 2).alias("x")))
    by = own.groupBy(*page).agg(widest.alias("m"), F.count("*").alias("n"), F.max("page_width").alias("page_width"))
    left = -F.col("m.left") - 1
    good = (F.col("n") >= 6) & (F.col("m.gap") >= 0.15 * F.col("page_width")) & (left >= 3) & (F.col("n") - left >= 3)
    return by.select(*page, F.when(good, F.col("m.x")).alias("gutter"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with `place` in reading order. Where a page has a gutter, blocks that cross it and have 60 % of the width
    divide the page into bands; in each band the left column comes before the right, by y0, the dividing block last."""
    own = blocks.join(gutters(blocks), ["doc_id", "page"])
    spans = F.coalesce((F.col("x0") < F.col("gutter")) & (F.col("gutter") < F.col("x1")) & (F.col("x1") - F.col("x0") >= 0.6 * F.col("page_width")), F.lit(False))
    own = own.withColumn("spans", spans)
    page = Window.partitionBy("doc_id", "page")
    # a block belongs to the band that the first dividing block below it closes
    band = F.sum(F.col("spans").cast("int")).over(page.orderBy("y0", F.col("spans").desc()).rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("band", band - F.col("spans").cast("int"))
    side = F.when(F.col("spans"), 2).when(F.col("gutter").isNull(), 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("gutter"), 0).otherwise(1)
    ends = [c for c in ("x1", "y1", "text") if c in own.columns]  # blocks that begin at one place come in one order
    place = F.row_number().over(page.orderBy("band", side, "y0", "x0", *ends))
    return own.withColumn("place", place).drop("band", "spans")


def running_headers(blocks: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """(doc_id, text, n): texts in the top or bottom tenth of at least max(least, share of all) of a document's pages.
    blocks has (doc_id, page, page_height, y0, y1, text)."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    edge = blocks.where("y1 <= 0.1 * page_height or y0 >= 0.9 * page_height")
    by = edge.groupBy("doc_id", F.trim("text").alias("text")).agg(F.count_distinct("page").alias("n"))
    return by.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.col("pages") * share)).select("doc_id", "text", "n")


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.4) -> DataFrame:
    """blocks of which less than `share` of the area lies in a table (doc_id, page, x0, y0, x1, y1) of the page."""
    t = tables.select("doc_id", "page", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "tx1") - F.greatest("x0", "tx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "ty1") - F.greatest("y0", "ty0"))
    same = (blocks["doc_id"] == t["doc_id"]) & (blocks["page"] == t["page"])
    return blocks.join(t, same & (wide * high >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "left_anti")


def table_markdown(rows: Column | str) -> Column:
    """An array of rows of cells as a Markdown table; rows are padded or cut to the width of the first."""
    rows = col(rows)
    width = F.size(F.get(rows, F.lit(0)))
    cell = lambda x: F.trim(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    made = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, F.lit(2), F.size(made))), "\n")


def distinct_headings(heads: DataFrame, least: int = 4) -> DataFrame:
    """heads (doc_id, pos, text) in which a text that occurs `least` times or more keeps its first place only."""
    by = Window.partitionBy("doc_id", "text")
    own = heads.withColumns({"n": F.count("*").over(by), "nth": F.row_number().over(by.orderBy("pos"))})
    return own.where((F.col("n") < least) | (F.col("nth") == 1)).drop("n", "nth")


def footer_numbers(blocks: DataFrame, share: float = 0.05) -> DataFrame:
    """(doc_id, page, number): the last line of one to four digits in the lowest part of a page; pages without one are
    left out. blocks has (doc_id, page, page_height, y0, x0, text)."""
    foot = blocks.where(F.col("y0") >= (1 - share) * F.col("page_height"))
    lines = foot.select("doc_id", "page", "y0", "x0", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("text", F.trim("text"))
    last = F.max(F.struct("y0", "x0", "line", F.col("text").alias("number")))
    return lines.where(F.col("text").rlike("^[0-9]{1,4}$")).groupBy("doc_id", "page").agg(last.alias("last")).select("doc_id", "page", F.col("last.number").cast("int").alias("number"))


def block_headings(blocks: DataFrame, ratio: float = 1.15, bold: float = 0.85, least: int = 5, most: int = 120) -> DataFrame:
    """(doc_id, page, y0, x0, level, text) of blocks (doc_id, page, y0, x0, size, bold_share, text) that are headings.

    A block whose largest font exceeds the page's median by `ratio` is one, of level 1 from twice the median on, 2 from
    one and a half, else 3, unless it has 200 characters or digits only. Else a first line of which `bold` is bold and
    that has `least` to `most` - 1 characters is one of level 2.
    """
    median = blocks.groupBy("doc_id", "page").agg(F.percentile("size", F.lit(0.5)).alias("median"))
    own = blocks.join(median, ["doc_id", "page"])
    head = heading_of(F.col("size"), F.col("median"), F.col("bold_share"), F.col("text"), F.lit(ratio), bold, least, most)
    return own.select("doc_id", "page", "y0", "x0", head.alias("head")).where("head is not null").select("doc_id", "page", "y0", "x0", "head.level", "head.text")


def heading_of(size: Column, median: Column, bold_share: Column, text: Column, ratio: Column, bold: float = 0.85, least: int = 5, most: int = 120) -> Column:
    """(level, text) of a block that is a heading as block_headings() has it, else null."""
    part = size / median
    large = F.coalesce((median > 0) & (size > median * ratio), F.lit(False))
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    line = F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    thick = ~large & (bold_share >= bold) & (F.length(line) >= least) & (F.length(line) < most)
    level = F.when(large & (part >= 2), 1).when(large & (part >= 1.5), 2).when(large, 3).when(thick, 2)
    own = F.when(large, one(text)).otherwise(one(line))
    fits = level.isNotNull() & (own != "") & ~own.rlike("^[0-9]+$") & (~large | (F.length(own) < 200))
    return F.when(fits, F.struct(level.alias("level"), own.alias("text")))
