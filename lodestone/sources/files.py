"""Files as tables: text, Markdown, FB2 and DOCX books, web pages, gold sets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NO_ANSWER_SENTINEL, drop_controls, extension, sanitize, strip, words

PARSED = "path string, text string, title string, author string, headings array<struct<pos:int,level:int,text:string>>, error string"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, n_lines, n_chars, n_words), a row per file; bytes that aren't UTF-8 become the replacement character."""
    raw = spark.read.format("binaryFile").load(path)
    text = sanitize(_utf8(F.col("content")))
    rows = raw.select("path", text.alias("text"))
    return rows.select("path", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.length("text").alias("n_chars"), F.size(words("text")).alias("n_words"))


def _utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def decode(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as text: UTF-8 if they are that, else by the fallback charset."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, fallback))


def from_base64(c: Column | str) -> Column:
    """The bytes of a strict base64 text, null for any other."""
    return F.try_to_binary(c, F.lit("base64"))


def markdown_facts(text: Column) -> tuple[Column, Column]:
    """(number of lines that begin with #, whether the text begins with front matter)."""
    heads = F.size(F.filter(F.split(text, "\n", -1), lambda x: strip(x).startswith("#")))
    return heads, strip(text).startswith("---")


def _name(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _with_headings(segments: list[tuple[str, int]]) -> tuple[str, list[dict]]:
    """Segments (text, level or 0) joined by blank lines, and where the headings stand."""
    at, heads = 0, []
    for text, level in segments:
        if 1 <= level <= 6:
            heads.append({"pos": at, "level": level, "text": text})
        at += len(text) + 2
    return "\n\n".join(t for t, _ in segments), heads


class _Mender(HTMLParser):
    """A tree of markup that isn't well formed. Names keep their case only where it is lower; an end tag closes what
    is open within its element, one without a start is left out, and what is open at the end is closed there."""

    def __init__(self):
        super().__init__()
        self.top = ElementTree.Element("")
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        self.open.append(ElementTree.SubElement(self.open[-1], tag.rsplit(":", 1)[-1], {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.open.pop()

    def handle_endtag(self, tag):
        tag = tag.rsplit(":", 1)[-1]
        names = [x.tag for x in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        here = self.open[-1]
        if len(here):
            here[-1].tail = (here[-1].tail or "") + data
        else:
            here.text = (here.text or "") + data


def mended(data: bytes) -> ElementTree.Element:
    """The tree of broken XML, with all that can be made of it. The charset is the one that is declared, else UTF-8."""
    named = re.search(rb"""^\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", data)
    try:
        text = data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        text = data.decode("utf-8", "replace")
    parser = _Mender()
    parser.feed(text)
    parser.close()
    return parser.top


def parse_fb2(data: bytes) -> dict:
    """Body text in order; section titles are headings of their depth. Broken XML is mended, which its error says; where
    nothing of a book is left in it, the file is plain text."""
    broken = None
    try:
        root = ElementTree.fromstring(data)
    except (ElementTree.ParseError, LookupError, ValueError) as e:  # not well formed, or in a charset that isn't known
        broken, root = str(e), mended(data)
        if not any(_name(x) == "body" for x in root.iter()):
            return {"text": data.decode("utf-8", "replace"), "title": None, "author": None, "headings": [], "error": broken}
    segments: list[tuple[str, int]] = []

    def walk(node: ElementTree.Element, depth: int) -> None:
        for child in node:
            kind = _name(child)
            if kind == "section":
                walk(child, depth + 1)
            elif kind in ("title", "p", "subtitle", "v", "text-author"):
                own = " ".join(" ".join(child.itertext()).split())
                if own:
                    segments.append((own, max(1, depth) if kind == "title" else 0))
            else:
                walk(child, depth)

    for body in root.iter():
        if _name(body) == "body":
            walk(body, 0)
    title = next((" ".join("".join(x.itertext()).split()) for x in root.iter() if _name(x) == "book-title"), None)
    authors = (" ".join(p.text.strip() for p in x if _name(p) in ("first-name", "middle-name", "last-name") and p.text and p.text.strip()) for x in root.iter() if _name(x) == "author")
    text, heads = _with_headings(segments)
    return {"text": text, "title": title, "author": next((a for a in authors if a), None), "headings": heads, "error": broken}


def parse_docx(data: bytes) -> dict:
    """Paragraphs, then the cells of all tables; paragraphs of a style `Heading N` are headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    plain = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD_NS}t"))
    segments = []
    for p in body.findall(f"{WORD_NS}p") if body is not None else []:
        style = p.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
        m = re.fullmatch(r"heading ?([1-6])", (style.get(f"{WORD_NS}val") or "").lower()) if style is not None else None
        if plain(p).strip():
            segments.append((plain(p), int(m[1]) if m else 0))
    for cell in body.iter(f"{WORD_NS}tc") if body is not None else []:
        if plain(cell).strip():
            segments.append((plain(cell), 0))
    text, heads = _with_headings(segments)
    return {"text": text, "title": None, "author": None, "headings": heads, "error": None}


class _Page(HTMLParser):
    """Visible text of a page with headings as Markdown, its title and canonical address."""

    BLOCKS = frozenset("p div section article li ul ol br tr table h1 h2 h3 h4 h5 h6 blockquote pre main header footer nav".split())
    HIDDEN = frozenset(("script", "style", "noscript", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.canonical, self.hidden, self.in_title = [], "", None, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "link" and dict(attrs).get("rel") == "canonical":
            self.canonical = dict(attrs).get("href")
        elif tag in self.BLOCKS:
            self.out.append("\n\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "\n\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def parse_html(html: str) -> tuple[str, str, str | None]:
    """(title, text, canonical address)."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = re.sub(r" *\n *", "\n", "".join(page.out))
    return page.title.strip(), re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", text)).strip(), page.canonical


def web_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, canonical, outcome) of pages (page_id, url, html); outcome is ok, empty or unavailable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_html(h) if h is not None else (None, None, None) for h in b["html"]]
            out = b[["page_id", "url"]].copy()
            for i, c in enumerate(("title", "text", "canonical")):
                out[c] = pd.Series([g[i] for g in got], dtype=object, index=out.index)
            out["outcome"] = ["unavailable" if h is None else "ok" if g[1] else "empty" for h, g in zip(b["html"], got, strict=True)]
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string, canonical string, outcome string")


def parse_plain(data: bytes) -> dict:
    """Text as UTF-8, or as Latin-1 where it isn't that."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return {"text": text, "title": None, "author": None, "headings": [], "error": None}


PARSERS: dict[str, Callable[[bytes], dict]] = {"fb2": parse_fb2, "docx": parse_docx, "txt": parse_plain, "md": parse_plain}


def register(kind: str, parser: Callable[[bytes], dict]) -> None:
    """Add a file type; the parser gives text, title, author, headings and error."""
    PARSERS[kind] = parser


def read_parsed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of a registered type as rows of PARSED; a file that can't be parsed has its error and no text."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.lit(kind).alias("kind"), "content")
    return _parsed(rows, {kind: PARSERS[kind]})


def _parsed(rows: DataFrame, parsers: dict[str, Callable[[bytes], dict]]) -> DataFrame:
    """Rows (path, kind, content) as PARSED, each by the parser of its kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for p, kind, data in zip(b["path"], b["kind"], b["content"], strict=True):
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for files of type {kind!r}")
                    made.append({"path": p, **parsers[kind](bytes(data))})
                except Exception as e:  # one bad file must not end the job; its row says why
                    made.append({"path": p, "text": None, "title": None, "author": None, "headings": [], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(made, columns=["path", "text", "title", "author", "headings", "error"])

    return rows.mapInPandas(run, PARSED).withColumn("text", drop_controls("text"))


def read_any(spark: SparkSession, root: str) -> DataFrame:
    """All files under a folder as rows of PARSED, each by the parser that its extension names; a file of another type,
    or one that can't be parsed, has its error and no text."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _parsed(rows.select("path", extension("path").alias("kind"), "content"), dict(PARSERS))


def inside(path: Column | str) -> Column:
    """A relative path without `.` and `..`; null if it is absolute, names nothing or would leave its root on the way."""
    c = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("parts"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up, parts = x == "..", acc["parts"]
        kept = F.when(up, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).when(x.isin("", "."), parts).otherwise(F.concat(parts, F.array(x)))
        return F.struct(kept.alias("parts"), (acc["ok"] & ~(up & (F.size(parts) == 0))).alias("ok"))

    done = F.aggregate(F.split(c, "/"), start, step)
    return F.when(done["ok"] & (F.size(done["parts"]) > 0) & ~c.rlike("^(/|[A-Za-z]:)"), F.array_join(done["parts"], "/"))


def received(rows: DataFrame, root: str) -> DataFrame:
    """PARSED rows (path: the name) of documents that were handed in: rows (name, content_base64, path) with either the
    content or the path of a file under `root`, whose name counts if none is given.

    Both or neither, a path that leaves the root, a file that isn't there, content that isn't Base64 and a type without
    a parser are errors of their row.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    spark = rows.sparkSession
    own = rows.select("name", "content_base64", "path", inside("path").alias("rel"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("full"), "content")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = files.withColumn("rel", F.substring("full", F.lit(len(base) + 2), F.length("full")))
    found = own.join(files, "rel", "left")
    given = from_base64("content_base64")
    error = (
        F.when(blank("content_base64") == blank("path"), "give either content or a path")
        .when(~blank("path") & F.col("rel").isNull(), "the path must stay within its folder")
        .when(~blank("path") & F.col("content").isNull(), F.concat(F.lit("there is no file "), "path"))
        .when(~blank("content_base64") & given.isNull(), "the content is not Base64")
    )
    name = F.coalesce(F.when(~blank("name"), F.col("name")), F.element_at(F.split("rel", "/"), -1), F.lit(""))
    found = found.select(name.alias("path"), extension(name).alias("kind"), F.coalesce("content", given).alias("content"), error.alias("why"))
    bad = found.where("why is not null").select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.col("why").alias("error"))
    fine = _parsed(found.where("why is null").drop("why"), dict(PARSERS))
    return fine.unionByName(bad.withColumn("headings", F.array().cast(fine.schema["headings"].dataType)))


def gold_samples(rows: DataFrame) -> DataFrame:
    """(question, answer, document_id, chunk_index) of rows with those columns as strings: rows without a question go,
    an empty answer means that none is expected, what is not an index or an id is null."""
    blank = lambda c: F.when(strip(c) != "", strip(c))
    uuid = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    return rows.where(blank("question").isNotNull()).select(
        blank("question").alias("question"),
        F.coalesce(blank("answer"), F.lit(NO_ANSWER_SENTINEL)).alias("answer"),
        F.when(strip("document_id").rlike(uuid), strip("document_id")).alias("document_id"),
        F.when(strip("chunk_index").rlike(r"^\d+$"), strip("chunk_index").try_cast("int")).alias("chunk_index"),
    )


GOLD = "question string, answer string, document_id string, chunk_index string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold samples from CSV with a header, or from JSON (an array or lines)."""
    if path.endswith(".csv"):
        return gold_samples(spark.read.option("header", True).schema(GOLD).option("enforceSchema", False).csv(path))
    return gold_samples(spark.read.schema(GOLD).option("multiLine", not path.endswith("l")).json(path))
