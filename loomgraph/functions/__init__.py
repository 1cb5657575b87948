"""The scalar and aggregating functions, by family.

A function takes typed columns and gives one; names are looked up without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable

from ..plans.values import Val

REGISTRY: dict[str, Callable[..., Val]] = {}


def function(*names: str):
    def add(f):
        for n in names:
            REGISTRY[n.lower()] = f
        return f

    return add


def load() -> dict[str, Callable[..., Val]]:
    from . import collections, maths, space, temporal, texts, vectors  # noqa: F401

    return REGISTRY
