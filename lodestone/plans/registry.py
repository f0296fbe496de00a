"""Queries by name and their SQL."""

from __future__ import annotations

from . import documents, layout, library, retrieval, runs, sentencing, stores, transfers

QUERIES = retrieval.QUERIES | documents.QUERIES | library.QUERIES | stores.QUERIES | layout.QUERIES | runs.QUERIES | transfers.QUERIES | sentencing.QUERIES
SQL: dict[str, str] = retrieval.SQL | documents.SQL | library.SQL | stores.SQL | layout.SQL | runs.SQL | transfers.SQL | sentencing.SQL
