"""The catalogue that operator modules register their queries in."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: The query that the smoke check runs.
FLAGSHIP = "op_tx09_bm25_top_k"

Build = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    name: str
    build: Build
    oracle: str | None
    covers: tuple[str, ...]


_ENTRIES: dict[str, Entry] = {}


def query(oracle: str | None = None, covers: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    """Registers a function as the named query it has; ``covers`` lists survey ids."""

    def add(f: Build) -> Build:
        if f.__name__ in _ENTRIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _ENTRIES[f.__name__] = Entry(f.__name__, f, oracle, covers)
        return f

    return add


class Catalog:
    def __init__(self) -> None:
        from quernstone import operators

        for m in pkgutil.iter_modules(operators.__path__):
            importlib.import_module(f"quernstone.operators.{m.name}")

    def entries(self) -> dict[str, Entry]:
        return dict(_ENTRIES)

    def queries(self) -> dict[str, Build]:
        return {k: e.build for k, e in _ENTRIES.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: e.oracle for k, e in _ENTRIES.items() if e.oracle}

    def flagship(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ENTRIES[FLAGSHIP].build(spark, sf_dir)
