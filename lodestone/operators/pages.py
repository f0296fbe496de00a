"""Page blocks to text: tables cut out, columns put in order, running headers dropped, headings and pages by offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drop_controls
from . import structure
from .store import fresh_folder

#: The share of a page in which running headers and footers lie, the share of pages that they are on and
#: pages at least, points added around them, and how far the zones reach at most.
ZONE, REPEATED, LEAST_PAGES, MARGIN, HEADER_MOST, FOOTER_LEAST = 0.10, 0.30, 3, 4.0, 0.10, 0.85
#: What may be set from outside, with its defaults.
DEFAULTS = {"table_strategy": ("string", "lines"), "size_ratio_threshold": ("double", 1.15), "min_doc_length": ("int", 100)}
#: The names of these settings in a scope's columns.
SCOPE_NAMES = {"pdf_table_strategy": "table_strategy", "pdf_heading_size_sensitivity": "size_ratio_threshold", "pdf_min_doc_length": "min_doc_length"}
#: Times that a heading's text may occur before only its first place counts.
HEADING_REPEATS = 4
BETWEEN = "\n\n"


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))


def overrides(*scopes: Column | None) -> dict[str, Column]:
    """Each setting from the last scope (a struct with columns of SCOPE_NAMES; any may lack or be null) that has it, else
    its default. Other fields of a scope don't count."""
    out = {}
    for field, name in SCOPE_NAMES.items():
        kind, default = DEFAULTS[name]
        out[name] = F.coalesce(*[s[field].cast(kind) for s in reversed(scopes) if s is not None], F.lit(default))
    return out


def profile(blocks: DataFrame) -> DataFrame:
    """(doc_id, header_zone, footer_zone, running) of blocks (doc_id, page, page_height, y0, y1, text).

    A text that begins in the top tenth of a page, or ends in the bottom tenth, on as many occasions as 30 % of the
    pages, and on three at least, runs through the document. The header zone reaches to the end of the lowest such
    header and a little farther, but to a tenth of the page at most; the footer zone begins a little above the highest
    such footer, but below 85 %. Without any, nothing is cut off. `running` are the headers' texts, few by their rule.
    """
    pages = blocks.groupBy("doc_id", "page").agg(F.max("page_height").alias("h")).groupBy("doc_id").agg(F.count("*").alias("pages"), F.percentile("h", F.lit(0.5)).alias("h"))
    own = blocks.select("doc_id", "page_height", "y0", "y1", one_line("text").alias("text")).where("text <> ''")
    top, bottom = F.col("y0") < ZONE * F.col("page_height"), F.col("y1") > (1 - ZONE) * F.col("page_height")
    seen = own.where(top | bottom).groupBy("doc_id", "text").agg(F.count_if(top).alias("tops"), F.max(F.when(top, F.col("y1"))).alias("y1"), F.count_if(bottom).alias("bottoms"), F.min(F.when(bottom, F.col("y0"))).alias("y0"))
    often = F.greatest(F.lit(LEAST_PAGES), F.col("pages") * REPEATED)
    held = seen.join(pages, "doc_id").where((F.col("tops") >= often) | (F.col("bottoms") >= often))
    up, down = F.col("tops") >= often, F.col("bottoms") >= often
    by = held.groupBy("doc_id").agg(F.max(F.when(up, F.col("y1"))).alias("y1"), F.min(F.when(down, F.col("y0"))).alias("y0"), F.collect_list(F.when(up, F.col("text"))).alias("running"))
    header = F.when(F.col("y1").isNotNull(), F.least((F.col("y1") + MARGIN) / F.col("h"), F.lit(HEADER_MOST))).otherwise(0.0)
    footer = F.when(F.col("y0") < F.col("h"), F.greatest((F.col("y0") - MARGIN) / F.col("h"), F.lit(FOOTER_LEAST))).otherwise(1.0)
    none = F.array().cast("array<string>")
    return pages.join(by, "doc_id", "left").select("doc_id", header.alias("header_zone"), footer.alias("footer_zone"), F.coalesce("running", none).alias("running"))


def kept_blocks(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """blocks outside the header and footer zones and tables, that are no running header and hold any text."""
    own = blocks.join(profile(blocks), "doc_id")
    inside = (F.col("y0") >= F.col("page_height") * F.col("header_zone")) & (F.col("y0") < F.col("page_height") * F.col("footer_zone"))
    own = own.where(inside & ~F.array_contains("running", one_line("text")) & (F.trim("text") != "")).drop("header_zone", "footer_zone", "running")
    return own if tables is None else structure.outside_tables(own, tables)


def assemble(blocks: DataFrame, tables: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, headings, pages, outcome) of a table of page blocks.

    blocks: doc_id, page (from 1), page_width, page_height, x0, y0, x1, y1, text, size (largest font) and bold_share (of
    the first line); tables: doc_id, page, x0, y0, x1, y1 and rows (cells), of which those of two rows or more become
    Markdown in their place; settings: doc_id and any of size_ratio_threshold and min_doc_length, null for the default.

    headings are (pos, level, text) by offset in the text, of a text that occurs four times or more the first alone;
    pages are (off, page, logical) with the printed number at the foot, if any. Pages without text are left out, as are
    documents without blocks. outcome is `ok`, or `too_short` for texts below min_doc_length, whose text is null.
    Everything but the final text of a document is a row per block; only that text is put together in one task. Blocks in
    reading order are written to the shared folder, as headings, pages and texts are all made of them.
    """
    spark_tables = tables.where(F.size("rows") >= 2) if tables is not None else None
    page = ["doc_id", "page"]
    size = blocks.select(*page, "page_width", "page_height").groupBy(*page).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    ratios = (settings if settings is not None else blocks.select("doc_id").distinct()).select("doc_id", *[(F.col(c) if settings is not None and c in settings.columns else F.lit(None)).cast(DEFAULTS[c][0]).alias(c) for c in ("size_ratio_threshold", "min_doc_length")])
    own = kept_blocks(blocks, spark_tables).join(ratios, "doc_id", "left")
    median = blocks.where("size > 0").groupBy(*page).agg(F.percentile("size", F.lit(0.5)).alias("median"))
    heads = structure.heading_of(F.col("size"), F.col("median"), F.col("bold_share"), F.col("text"), F.coalesce("size_ratio_threshold", F.lit(DEFAULTS["size_ratio_threshold"][1])))
    items = own.join(median, page, "left").select(*page, "page_width", "x0", "y0", "x1", "text", heads.alias("heading"))
    if spark_tables is not None:
        made = spark_tables.join(size, page).select(*page, "page_width", "x0", "y0", "x1", structure.table_markdown("rows").alias("text"), F.lit(None).cast("struct<level:int,text:string>").alias("heading"))
        items = items.unionByName(made)
    placed = structure.reading_order(items).withColumn("text", drop_controls("text"))
    folder = f"{fresh_folder(blocks.sparkSession, 'pages')}/placed"
    placed.write.parquet(folder)
    placed = blocks.sparkSession.read.schema(placed.schema).parquet(folder)
    run = Window.partitionBy(*page).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("off", F.coalesce(F.sum(F.length("text") + len(BETWEEN)).over(run), F.lit(0)))
    by_page = placed.groupBy(*page).agg(F.sum(F.length("text") + len(BETWEEN)).alias("n"), F.max(F.trim("text") != "").alias("some")).where("some")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    by_page = by_page.select(*page, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    whole = placed.join(by_page, page).withColumn("pos", (F.col("start") + F.col("off")).cast("int"))
    found = structure.distinct_headings(whole.where("heading is not null").select("doc_id", "pos", F.col("heading.level").alias("level"), F.col("heading.text").alias("text")), HEADING_REPEATS)
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "text"))).alias("headings"))
    numbered = by_page.join(structure.footer_numbers(blocks), page, "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("off"), "page", F.col("number").alias("logical")))).alias("pages"))
    texts = whole.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place", "text"))), lambda x: x["text"]), BETWEEN).alias("text"))
    out = texts.join(numbered, "doc_id").join(listed, "doc_id", "left").join(ratios, "doc_id", "left")
    short = F.length(F.trim("text")) < F.coalesce("min_doc_length", F.lit(DEFAULTS["min_doc_length"][1]))
    none = F.array().cast("array<struct<pos:int,level:int,text:string>>")
    return out.select("doc_id", F.when(~short, F.col("text")).alias("text"), F.coalesce("headings", none).alias("headings"), "pages", F.when(short, "too_short").otherwise("ok").alias("outcome"))
