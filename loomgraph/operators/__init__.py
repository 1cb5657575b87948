"""Operators that Spark lacks: path expansion, search, graph rewrites."""
