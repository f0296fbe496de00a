"""Export of collections with all that belongs to them, and import into a catalog that may hold some of it already."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import catalog

#: The version of the layout, and each table with the column that names what its rows belong to.
VERSION = 1
PARENT = {"documents": ("collection_id", "collections"), "vectors": ("document_id", "documents"), "conversations": ("collection_id", "collections"), "messages": ("conversation_id", "conversations")}


class TransferError(ValueError):
    """An export or import that can't be done as asked; nothing was changed."""


@dataclass(frozen=True)
class Include:
    """What goes along with the collections."""

    documents: bool = True
    vectors: bool = True
    chats: bool = True

    def __post_init__(self):
        if (self.vectors or self.chats) and not self.documents:
            raise TransferError("vectors and chats go with documents only")

    def tables(self) -> list[str]:
        return ["collections"] + ["documents"] * self.documents + ["vectors"] * self.vectors + ["conversations", "messages"] * self.chats


def belonging(tables: dict[str, DataFrame], ids: DataFrame, include: Include) -> dict[str, DataFrame]:
    """The rows of the included tables that belong to the collections in ids (id), by semi-joins down from these."""
    out = {"collections": tables["collections"].join(ids.select("id").distinct(), "id", "left_semi")}
    for name in include.tables()[1:]:
        column, above = PARENT[name]
        keys = out[above].select(F.col("id").alias("__key"))
        out[name] = tables[name].join(keys, F.col(column) == F.col("__key"), "left_semi")
    return out


def export(tables: dict[str, DataFrame], ids: DataFrame, folder: str, include: Include = Include()) -> dict:
    """Write collections and what belongs to them as JSON lines, with what was written as `metadata`, which is returned.

    A collection that isn't there, or is deleted, is an error. The order of rows is open.
    """
    live = tables["collections"].where("not is_deleted") if "is_deleted" in tables["collections"].columns else tables["collections"]
    asked = ids.select("id").distinct()
    if asked.join(live.select("id"), "id", "left_anti").limit(1).count():
        raise TransferError("one or more collections are not there")
    own = belonging(tables, asked, include)
    catalog.write_export(own, folder)
    metadata = {"version": VERSION, "include": asdict(include), "schemas": {n: df.schema.jsonValue() for n, df in own.items()}}
    ids.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return metadata


def read(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of an export and its metadata; another version of the layout is an error."""
    metadata = json.loads(spark.read.text(f"{folder}/metadata").first().value)
    if metadata["version"] != VERSION:
        raise TransferError(f"exports of version {metadata['version']} aren't known")
    return catalog.read_export(spark, folder, {n: StructType.fromJson(x) for n, x in metadata["schemas"].items()}), metadata


def new_id(old: Column, salt: str) -> Column:
    """An id by an old one and a salt: the same in every run, so that an import that is run again makes the same rows."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), old.cast("string")), 256), 1, 32)


def import_into(current: dict[str, DataFrame], archive: dict[str, DataFrame], include: Include = Include(), mode: str = "create", salt: str | None = None, target: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): the current tables with those of an archive brought in.

    Mode `create` adds all rows; an id that is there already is an error. Mode `merge` puts rows in the place of those of
    their id and adds the others. With a `salt` all ids become new ones, so nothing is replaced; sources of messages
    follow, as far as their documents came along. `target`, in mode merge, brings the documents and chats of an archive
    of one collection into that collection, which stays as it is; if vectors come along, its embedding_model and
    embedding_dimension must be the archive's. Documents and conversations of a collection that isn't in the archive are
    an error; vectors and messages without their document or conversation are left out and counted.

    report: (name, created, updated, orphans). Ids are compared as strings, keyed tables by one join each; nothing but
    counts comes to the driver.
    """
    if mode not in ("create", "merge"):
        raise TransferError(f"mode {mode!r} is neither create nor merge")
    names = include.tables()
    if lacking := [n for n in names if n not in archive]:
        raise TransferError(f"the archive has no {', '.join(lacking)}")
    rows = {n: archive[n].withColumn("id", F.col("id").cast("string")) for n in names}
    for n, (column, _) in PARENT.items():
        if n in rows:
            rows[n] = rows[n].withColumn(column, F.col(column).cast("string"))
    if target is not None:
        _check_target(current, rows, include, mode, target)
    orphans = {n: 0 for n in names}
    for n in names[1:]:
        column, above = PARENT[n]
        lost = rows[n].join(rows[above].select(F.col("id").alias("__key")), F.col(column) == F.col("__key"), "left_anti")
        orphans[n] = lost.count()
        if orphans[n] and above == "collections" and target is None:
            raise TransferError(f"{orphans[n]} {n} belong to collections that aren't in the archive")
        if orphans[n] and above != "collections":
            rows[n] = rows[n].join(rows[above].select(F.col("id").alias("__key")), F.col(column) == F.col("__key"), "left_semi")
        elif target is not None:
            orphans[n] = 0
    if salt is not None:
        rows = _renamed(rows, salt)
    if target is not None:
        rows = {n: df.withColumn("collection_id", F.lit(target)) if n in ("documents", "conversations") else df for n, df in rows.items() if n != "collections"}
    tables, counts = dict(current), []
    for n, new in rows.items():
        known = current[n].withColumn("id", F.col("id").cast("string"))
        total, there = new.count(), new.join(known.select("id"), "id", "left_semi").count()
        if there and mode == "create":
            raise TransferError(f"{there} {n} are there already")
        tables[n] = catalog.upsert(known, new, ["id"])
        counts.append((n, total - there, there, orphans[n]))
    if target is not None:
        counts.append(("collections", 0, 1, 0))
    return tables, current["collections"].sparkSession.createDataFrame(counts, "name string, created long, updated long, orphans long")


def _check_target(current: dict[str, DataFrame], rows: dict[str, DataFrame], include: Include, mode: str, target: str) -> None:
    if mode != "merge":
        raise TransferError("a target is for mode merge")
    come = rows["collections"].limit(2).collect()
    if len(come) != 1:
        raise TransferError("a target needs an archive of one collection")
    there = current["collections"].where(F.col("id").cast("string") == target).first()
    if there is None:
        raise TransferError(f"there is no collection {target!r}")
    if include.vectors and any(there[c] != come[0][c] for c in ("embedding_model", "embedding_dimension")):
        raise TransferError("the target's embeddings are others than the archive's; import without vectors and index anew")


def _renamed(rows: dict[str, DataFrame], salt: str) -> dict[str, DataFrame]:
    """rows with new ids, and with what points at them."""
    out = {}
    for n, df in rows.items():
        if n in PARENT:
            df = df.withColumn(PARENT[n][0], new_id(F.col(PARENT[n][0]), salt))
        if n == "messages" and "sources" in df.columns:
            ids = rows["documents"].select(F.col("id").alias("old_id"), new_id(F.col("id"), salt).alias("new_id"))
            df = catalog.remap_sources(df, ids, "id")
        out[n] = df.withColumn("id", new_id(F.col("id"), salt))
    return out
