"""Every registered query, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_queries, conversation_queries, engine_queries, extraction_queries, file_queries, search_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _m in (search_queries, chat_queries, conversation_queries, extraction_queries, engine_queries, stream_queries, file_queries):
    QUERIES |= _m.Q.queries
    ORACLE |= _m.Q.oracle

