"""Which indexes exist, and which one a query means."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lexispark.functions.text import analyze
from lexispark.operators.build import IndexTables
from lexispark.operators.search import search
from lexispark.operators.standalone import scored
from lexispark.plans.query import Bm25Query, Bm25Vector
from lexispark.plans.spec import IndexSpec

log = logging.getLogger("lexispark")


@dataclass
class Catalog:
    """Indexes by name; `tables` gives an index's tables when it is used."""

    entries: dict[str, tuple[IndexSpec, Callable[[], IndexTables]]] = field(default_factory=dict)

    def add(self, spec: IndexSpec, tables: Callable[[], IndexTables]) -> None:
        if spec.name in self.entries:
            raise ValueError(f'index "{spec.name}" already exists')
        self.entries[spec.name] = (spec, tables)

    def drop(self, name: str) -> None:
        self.spec(name)
        del self.entries[name]

    def spec(self, name: str) -> IndexSpec:
        """By name, or schema.name where the plain name is unknown."""
        for key in (name, name.rpartition(".")[2]):
            if key in self.entries:
                return self.entries[key][0]
        raise ValueError(f'index "{name}" does not exist')

    def open(self, name: str) -> IndexTables:
        return self.entries[self.spec(name).name][1]()

    def resolve(self, table: str, column: str | None, query: Bm25Query | str) -> IndexSpec:
        """The index of a query on a table's column: the named one if it fits, else the first full one there."""
        if column is None:
            raise ValueError("left operand of <@> must reference a table column")
        plain, query = isinstance(query, str), Bm25Query(query) if isinstance(query, str) else query
        if query.index is not None:
            spec = self.spec(query.index)
            if spec.table != table or spec.column != column:
                raise ValueError(f'index "{query.index}" is not on column "{column}"')
            return spec
        here = [s for s, _ in self.entries.values() if s.table == table and s.column == column]
        full = [s for s in here if not s.where]
        if not full and here:
            raise ValueError(f"no non-partial BM25 index found for this column ({len(here)} partial index(es) skipped)")
        if not full:
            raise ValueError("no BM25 index found for text <@> text expression" if plain else "text <@> bm25query operator requires index")
        if len(full) > 1:
            log.warning("multiple BM25 indexes exist on the same %s", "expression" if full[0].expression else "column")
        return full[0]

    def search(self, table: str, column: str, query: Bm25Query | str, limit: int | None = 10, **options) -> DataFrame:
        text = query.text if isinstance(query, Bm25Query) else query
        return search(self.open(self.resolve(table, column, query).name), text, limit, **options)

    def scored(self, df: DataFrame, table: str, column: str, query: Bm25Query | str, **options) -> DataFrame:
        text = query.text if isinstance(query, Bm25Query) else query
        return scored(df, self.open(self.resolve(table, column, query).name), text, **options)

    def to_bm25vector(self, text: str, name: str) -> Bm25Vector:
        spec, tables = self.spec(name), self.open(name)
        return Bm25Vector.of(spec.name, analyze(tables.docs.sparkSession, text, spec.text_config))
