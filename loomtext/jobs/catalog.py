"""All named queries over the given tables and the SQL they are held against."""

from __future__ import annotations

from loomtext.jobs import chunking, governance, operations, retrieval, services, stored, texts, vectors  # noqa: F401
from loomtext.jobs.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
