"""Every operator as a named query over the tables of a folder, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ["cleaning", "text", "vectors", "clusters", "keywords", "lexical", "questions", "reading", "stores", "evaluation", "sources", "jobs"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may use the views of this package (blocks, docs) as {blocks} and {docs}."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("{blocks}", BLOCKS).replace("{docs}", DOCS).replace("{feedback}", FEEDBACK)
        return f

    return register


#: Deliveries of one record differ in received_at (blocks, feedback) or arrive later (documents); one of them counts.
BLOCKS = "(select distinct on (block_id) * from idea_blocks)"
FEEDBACK = "(select distinct on (feedback_id) * from feedback)"
DOCS = "(select * from document_record qualify row_number() over (partition by doc_id order by arrival_id) = 1)"


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for m in MODULES:
        import_module(f"corpusloom.catalog.{m}")
    return QUERIES, SQL
