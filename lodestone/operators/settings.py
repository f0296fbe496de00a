"""Settings from several scopes, the nearest that has a value winning field by field; input checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_list, col, extension, uuids

#: Fields of a retrieval with their types and defaults.
FIELDS = {
    "top_k": ("int", 5),
    "retrieval_mode": ("string", "dense"),
    "lexical_top_k": ("int", 20),
    "hybrid_dense_weight": ("double", 0.6),
    "hybrid_lexical_weight": ("double", 0.4),
    "max_context_chars": ("int", 0),
    "score_threshold": ("double", 0.0),
    "use_mmr": ("boolean", False),
    "mmr_diversity": ("double", 0.5),
    "context_expansion": ("array<string>", None),
    "context_window": ("int", None),
    "rerank_enabled": ("boolean", False),
    "rerank_provider": ("string", "auto"),
    "rerank_model": ("string", "rerank-2.5-lite"),
    "rerank_candidate_pool": ("int", 20),
    "rerank_top_n": ("int", None),
    "rerank_min_score": ("double", None),
    "bm25_match_mode": ("string", "balanced"),
    "bm25_min_should_match": ("int", 50),
    "bm25_use_phrase": ("boolean", True),
    "bm25_analyzer": ("string", "mixed"),
}
#: From the farthest scope to the nearest, after the defaults.
SCOPES = ("app", "collection_columns", "collection", "conversation", "request")
#: Fields that the app's settings don't have.
NOT_IN_APP = ("use_mmr", "mmr_diversity", "context_expansion", "context_window")
SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in FIELDS.items())


def resolve(rows: DataFrame) -> DataFrame:
    """rows (id and a JSON string column per scope) as one row with each field's value and, as <field>_from, its scope.

    A null never overrides; JSON that can't be read counts as absent, as does a scope without a column. The app has no
    fields in NOT_IN_APP, a collection's own columns have the BM25 fields only.
    """
    scopes = [s for s in reversed(SCOPES) if s in rows.columns]
    own = rows.select("id", *[F.from_json(s, SCHEMA).alias(s) for s in scopes])
    out = []
    for name, (kind, default) in FIELDS.items():
        having = [s for s in scopes if not (s == "app" and name in NOT_IN_APP or s == "collection_columns" and not name.startswith("bm25_"))]
        near = [F.col(f"{s}.{name}") for s in having]
        source = F.when(F.lit(False), F.lit(""))
        for s, c in zip(having, near, strict=True):
            source = source.when(c.isNotNull(), s)
        out += [F.coalesce(*near, F.lit(default).cast(kind)).alias(name), source.otherwise("default").alias(f"{name}_from")]
    return own.select("id", *out)


def scoped(key: Column | str, request: Column, *others: Column, fallback: Column | None = None) -> Column:
    """The value of a key in maps of scopes from the nearest to the farthest: the request's if it has the key, null or
    not; else the first that isn't null; else the fallback. A scope that is null has no key."""
    name = F.lit(key) if isinstance(key, str) else key
    rest = [F.try_element_at(m, name) for m in others] + ([] if fallback is None else [fallback])
    return F.when(F.map_contains_key(request, name), F.try_element_at(request, name)).otherwise(F.coalesce(*rest) if rest else F.lit(None))


def range_errors() -> Column:
    """An array with the names of fields of a resolved row that are out of range."""
    tests = {
        "top_k": F.col("top_k").between(1, 100),
        "lexical_top_k": F.col("lexical_top_k").between(1, 200),
        "hybrid_dense_weight": F.col("hybrid_dense_weight").between(0, 1),
        "hybrid_lexical_weight": F.col("hybrid_lexical_weight").between(0, 1),
        "mmr_diversity": F.col("mmr_diversity").between(0, 1),
        "context_window": F.col("context_window").isNull() | F.col("context_window").between(0, 5),
    }
    return F.array_compact(F.array(*[F.when(~t, name) for name, t in tests.items()]))


def file_error(name: Column | str, size: Column | str, kinds: tuple[str, ...] = ("txt", "md", "fb2", "docx", "pdf"), most: int = 50 << 20) -> Column:
    """Why a file isn't accepted, or null."""
    n = col(name)
    bad_name = n.isNull() | (F.length(n) == 0) | (F.length(n) > 255) | n.contains("..") | n.rlike(r'[/\\<>:"|?*\x00-\x1f]')
    return F.when(bad_name, "name").when(~extension(n).isin(*kinds), "type").when(col(size) <= 0, "empty").when(col(size) > most, "size")


#: Services that can rerank, in the order in which `auto` takes the first that has a key.
RERANKERS = ("voyage", "cohere")


def reranker(wanted: Column | str, keys: dict[str, Column]) -> Column:
    """The service that reranks: the one that is wanted if it has a key, null if it has none; for `auto`, null, and any
    other name the first of RERANKERS with a key. A key (by service) that is null or blank is none."""
    name = F.lower(F.trim(F.coalesce(col(wanted), F.lit("auto"))))
    has = {r: F.coalesce(F.trim(keys[r]) != "", F.lit(False)) if r in keys else F.lit(False) for r in RERANKERS}
    best, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(RERANKERS):
        best = F.when(has[r], r).otherwise(best)
        own = F.when((name == r) & has[r], r).otherwise(own)
    return F.when(name.isin(*RERANKERS), own).otherwise(best)


def document_filter(request: Column | str, saved: Column | str, use_saved: Column | str) -> Column:
    """The documents that a question is confined to (null: all): the request's list if it has one, even an empty one;
    else the valid ids of the conversation's list, if that is switched on and any is left."""
    own = uuids(saved)
    return F.when(col(request).isNotNull(), col(request)).when(F.coalesce(col(use_saved), F.lit(False)) & (F.size(own) > 0), own)


def enabled(tool: Column | str, listed: Column | str, default: tuple[str, ...]) -> Column:
    """Whether a tool is in the list that is set (JSON or comma-separated), or in the default one where none is set."""
    own = as_list(listed)
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.array_contains(own, col(tool))).otherwise(col(tool).isin(*default))


def any_key(rows: DataFrame, keys: list[str], column: str = "key") -> bool:
    """Whether rows have any of the keys; one row at most is looked for."""
    return bool(rows.where(F.col(column).isin(keys)).limit(1).count())


def untitled(rows: DataFrame, title: str = "title") -> DataFrame:
    """The rows without a title; a blank one is a title."""
    return rows.where(F.col(title).isNull())
