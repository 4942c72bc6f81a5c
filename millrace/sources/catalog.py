"""What tables there are: their columns, whether they are heaps or sorted, and where their data lies.

The catalog is one text file of blocks (BEGIN, table, source file, a line for each column, END), as tables are
exchanged, with a JSON file beside it for what the blocks can't say.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.errors import QueryError
from millrace.functions.expressions import kind_of

from . import files

# The words for kinds in catalog files.
WORDS = {"int": "Int", "double": "Double", "string": "String"}
TYPES = {"int": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[tuple[str, str], ...]  # (column, kind)
    path: str
    sort_columns: tuple[str, ...] = ()
    source: str = ""

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[k]) for c, k in self.columns])


def parse_catalog(text: str) -> dict[str, tuple[str, tuple[tuple[str, str], ...]]]:
    """table -> (source file, columns) of catalog text; the first block of a name counts."""
    kinds = {word: kind for kind, word in WORDS.items()}
    out: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {}
    words = iter(text.split())
    for word in words:
        if word != "BEGIN":
            raise QueryError(f"a catalog block starts with BEGIN, not {word}")
        table, source, columns = next(words, ""), next(words, ""), []
        for column in words:
            if column == "END":
                break
            kind = next(words, "")
            if kind not in kinds:
                raise QueryError(f"{table}.{column}: {kind or 'nothing'} is no type")
            columns.append((column, kinds[kind]))
        else:
            raise QueryError(f"the block of {table} has no END")
        out.setdefault(table, (source, tuple(columns)))
    return out


def format_catalog(tables: list[TableInfo]) -> str:
    blocks = (["BEGIN", t.name, t.source or f"{t.name}.tbl", *(f"{c} {WORDS[k]}" for c, k in t.columns), "END", ""] for t in tables)
    return "\n".join("\n".join(b) for b in blocks)


class Catalog:
    """The tables of a root folder, in any store that Spark reaches; without one, they live in memory only."""

    def __init__(self, root: str | None = None, spark: SparkSession | None = None):
        self.root, self.tables = root and root.rstrip("/"), {}
        if root:
            self.spark = spark or SparkSession.active()
            files.make_folder(self.spark, self.root)
            if files.exists(self.spark, self._file):
                more = json.loads(files.read_text(self.spark, self._side))
                for name, (source, columns) in parse_catalog(files.read_text(self.spark, self._file)).items():
                    if name in more:  # the JSON file is written first: a table is there once both have it
                        self.tables[name] = TableInfo(name, columns, more[name]["path"], tuple(more[name]["sort_columns"]), source)

    @property
    def _file(self) -> str:
        return f"{self.root}/catalog"

    @property
    def _side(self) -> str:
        return f"{self.root}/catalog.json"

    def __getitem__(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise QueryError(f"there is no table {name}")
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def add(self, table: TableInfo) -> None:
        if table.name in self.tables:
            raise QueryError(f"there is a table {table.name} already")
        self.tables[table.name] = table
        self._save()

    def remove(self, name: str) -> TableInfo:
        out = self[name]
        del self.tables[name]
        self._save()
        return out

    def moved(self, name: str, path: str) -> None:
        self.tables[name] = replace(self[name], path=path)
        self._save()

    def _save(self) -> None:
        if not self.root:
            return
        more = {t.name: {"path": t.path, "sort_columns": t.sort_columns} for t in self.tables.values()}
        files.write_text(self.spark, self._side, json.dumps(more, indent=1))
        files.write_text(self.spark, self._file, format_catalog(list(self.tables.values())))


def columns_of(schema: T.StructType) -> tuple[tuple[str, str], ...]:
    """(column, kind) of a frame's schema; times count as strings."""
    return tuple((f.name, "string" if (kind := kind_of(f.dataType)) == "time" else kind) for f in schema.fields)


def whole_order(schema: T.StructType) -> list[str]:
    """The order of a whole schema: its ints, then doubles, then strings."""
    kinds = dict(columns_of(schema))
    return [c for kind in ("int", "double", "string") for c in kinds if kinds[c] == kind]
