"""One exception class; ``category`` says what went wrong."""

from __future__ import annotations

#: The public error categories.
CATEGORIES = [
    "SYNTAX_ERROR", "SEMANTIC_ERROR", "TYPE_ERROR", "INVALID_ARGUMENT", "CONSTRAINT_VIOLATION", "SCHEMA_ERROR",
    "VERSION_NOT_FOUND", "VERSION_CONFLICT", "MERGE_CONFLICT", "TRANSACTION_ERROR", "ACCESS_DENIED", "GRAPH_VIEW_VIOLATION",
    "READ_ONLY", "EXTERNAL_IO_DENIED", "UNSUPPORTED", "RESOURCE_LIMIT", "INTEGRITY_ERROR", "NOT_FOUND", "ALREADY_EXISTS", "INTERNAL_ERROR",
]


class GraphError(Exception):
    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category = category


def syntax(message: str) -> GraphError:
    return GraphError("SYNTAX_ERROR", message)


def semantic(message: str) -> GraphError:
    return GraphError("SEMANTIC_ERROR", message)


def type_error(message: str) -> GraphError:
    return GraphError("TYPE_ERROR", message)


def invalid(message: str) -> GraphError:
    return GraphError("INVALID_ARGUMENT", message)
