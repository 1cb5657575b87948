"""Cypher front end: text to syntax tree."""

from .parser import parse

__all__ = ["parse"]
