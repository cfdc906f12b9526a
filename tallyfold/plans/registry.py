"""All registered queries and their SQL, by module."""

from __future__ import annotations

from collections.abc import Callable

from . import answers, documents, feeds, finance

MODULES = (finance, documents, answers, feeds)


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
