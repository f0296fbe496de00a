"""Collections and documents: counters, pages of listings, upserts and deletes by rewriting, export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def counters(docs: DataFrame, chunks: DataFrame, collection: str = "collection") -> DataFrame:
    """(collection, n_documents, n_chunks) over documents that aren't deleted; chunks are counted before the join."""
    live = docs.where("not is_deleted") if "is_deleted" in docs.columns else docs
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return live.join(per, "doc_id", "left").groupBy(collection).agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a listing."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and have 1 to 500 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    """(total, pages)."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with rows of the same key replaced by those of new, and new's others added."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def new_documents(incoming: DataFrame, known: DataFrame, collection: str = "collection") -> DataFrame:
    """Rows of incoming whose content isn't in their collection yet; of equal ones the smallest doc_id."""
    own = incoming.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = own.groupBy(collection, "content_hash").agg(F.min("doc_id").alias("doc_id"))
    kept = own.join(first, [collection, "content_hash", "doc_id"], "left_semi")
    return kept.join(known.select(collection, "content_hash"), [collection, "content_hash"], "left_anti")


def soft_delete(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with is_deleted set for the doc_ids in gone."""
    marks = gone.select("doc_id").distinct().withColumn("__gone", F.lit(True))
    return docs.join(marks, "doc_id", "left").withColumn("is_deleted", F.coalesce("__gone", "is_deleted", F.lit(False))).drop("__gone")


def orphans(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) chunks: those of deleted documents are dropped."""
    dead = docs.where("is_deleted").select("doc_id")
    return chunks.join(dead, "doc_id", "left_anti"), chunks.join(dead, "doc_id", "left_semi")


def remap(rows: DataFrame, ids: DataFrame, column: str, keep_unknown: bool = True) -> DataFrame:
    """rows with `column` put through ids (old_id, new_id); unknown ids stay, or their rows go."""
    m = ids.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    joined = rows.join(m, rows[column] == m["__old"], "left" if keep_unknown else "inner")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def remap_sources(rows: DataFrame, ids: DataFrame, key: str, sources: str = "sources") -> DataFrame:
    """rows with the document_id of each element of the array `sources` put through ids; order stays. Only the ids are
    shuffled: rows come together again by their key."""
    at = rows.select(key, F.posexplode(sources).alias("pos", "s"))
    mapped = remap(at.select(key, "pos", "s.document_id"), ids, "document_id")
    by = mapped.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "document_id"))), lambda x: x["document_id"]).alias("__ids"))
    new = F.zip_with(F.col(sources), F.col("__ids"), lambda s, i: s.withField("document_id", i))
    return rows.join(by, key, "left").withColumn(sources, F.coalesce(new, F.col(sources))).drop("__ids")


def write_export(tables: dict[str, DataFrame], folder: str, collections: DataFrame | None = None, column: str = "collection") -> None:
    """Each table as JSON lines in a folder of its own, whole or for the collections given."""
    for name, df in tables.items():
        own = df if collections is None or column not in df.columns else df.join(collections.select(column), column, "left_semi")
        own.write.mode("overwrite").json(f"{folder}/{name}")


def read_export(spark: SparkSession, folder: str, schemas: dict[str, str | StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def newest(rows: DataFrame, n: int, by: Column) -> DataFrame:
    """The n newest rows."""
    return rows.orderBy(by.desc()).limit(n)


def replace_samples(old: DataFrame, new: DataFrame, replaced: DataFrame, column: str = "collection") -> DataFrame:
    """old and new samples, without the old ones of the collections in `replaced`."""
    return delete(old, replaced, [column]).unionByName(new, allowMissingColumns=True)


def oldest(rows: DataFrame, by: list[Column], n: int | None = None) -> DataFrame:
    """rows in order, the first n if a number is given."""
    out = rows.orderBy(*by)
    return out if n is None else out.limit(n)


def latest(rows: DataFrame, by: Column, key: list[str]) -> DataFrame:
    """The newest row of each key: the one in force of settings or prompts that are only ever added to."""
    best = rows.groupBy(*key).agg(F.max(F.struct(by.alias("by"), F.struct(*rows.columns).alias("row"))).alias("best"))
    return best.select("best.row.*")


def cascade(collections: DataFrame, docs: DataFrame, marked: DataFrame, restore: bool = False, statuses: tuple[str, ...] = ("status", "embeddings_status", "bm25_status")) -> tuple[DataFrame, DataFrame]:
    """(collections, docs) after the marked collections were deleted softly with their documents, or restored; what is
    restored must be indexed anew, so its statuses become pending."""
    mark = marked.select("collection").distinct().withColumn("__marked", F.lit(True))

    def turned(df: DataFrame) -> DataFrame:
        own = df.join(mark, "collection", "left")
        hit = F.coalesce("__marked", F.lit(False))
        own = own.withColumn("is_deleted", F.when(hit, not restore).otherwise(F.col("is_deleted")))
        if restore:
            own = own.withColumns({c: F.when(hit, "pending").otherwise(F.col(c)) for c in statuses if c in df.columns})
        return own.drop("__marked")

    return turned(collections), turned(docs)


def purge(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """rows without those of collections that are deleted."""
    return rows.join(collections.where("is_deleted").select("collection"), "collection", "left_anti")


def backfill(rows: DataFrame, column: str, values: dict[str, str], default: str) -> DataFrame:
    """rows with the values of a column renamed; null ones get the default, others stay."""
    c = F.col(column)
    new = F.when(c.isNull(), default)
    for old, other in values.items():
        new = new.when(c == old, other)
    return rows.withColumn(column, new.otherwise(c))


def missing(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """rows and those wanted whose key isn't there."""
    return rows.unionByName(wanted.join(rows.select(*key), key, "left_anti"), allowMissingColumns=True)


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that aren't revoked, used up or expired; one that expires now is."""
    gone = F.col("revoked_at").isNotNull() | F.coalesce(F.col("expires_at") <= now, F.lit(False)) | F.coalesce(F.col("used"), F.lit(False))
    return tokens.where(~gone)


def matching(rows: DataFrame, title: str, key: str, text: str, label: str = "untitled chat") -> DataFrame:
    """rows whose title (the label if blank) or key holds the text, in any case; a blank text fits all."""
    low = text.strip().lower()
    shown = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(label))
    return rows.where(F.lower(shown).contains(low) | F.lower(F.col(key).cast("string")).contains(low)) if low else rows
