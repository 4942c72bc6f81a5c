"""The abstract syntax of statements, predicates and arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A column, qualified by a table's alias or bare."""

    column: str
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.alias}.{self.column}" if self.alias else self.column


@dataclass(frozen=True)
class Literal:
    """kind is "int", "double" or "string"."""

    value: int | float | str
    kind: str

    def __str__(self) -> str:
        return f"'{self.value}'" if self.kind == "string" else str(self.value)


@dataclass(frozen=True)
class Comparison:
    left: Name | Literal
    op: str
    right: Name | Literal

    def names(self) -> list[Name]:
        return [side for side in (self.left, self.right) if isinstance(side, Name)]

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


#: A disjunction, and a conjunction of disjunctions.
Disjunction = tuple[Comparison, ...]
Cnf = tuple[Disjunction, ...]


def show(cnf: Cnf) -> str:
    return " AND ".join("(" + " OR ".join(map(str, terms)) + ")" for terms in cnf)


@dataclass(frozen=True)
class Negate:
    operand: "Expression"

    def __str__(self) -> str:
        return f"-({self.operand})"


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: "Expression"
    right: "Expression"

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


Expression = Name | Literal | Negate | Arithmetic


@dataclass(frozen=True)
class Sum:
    expression: Expression
    distinct: bool = False

    def __str__(self) -> str:
        return f"SUM {'DISTINCT ' if self.distinct else ''}({self.expression})"


@dataclass(frozen=True)
class Output:
    """A column of the SELECT list, and the name it gets if one is given."""

    name: Name
    rename: str | None = None


@dataclass(frozen=True)
class Select:
    tables: tuple[tuple[str, str], ...]  # (table, alias)
    columns: tuple[Output, ...] = ()
    total: Sum | None = None
    distinct: bool = False
    where: Cnf = ()
    group_by: tuple[Name, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]  # (column, kind)
    sort_columns: tuple[str, ...] = field(default=())

    @property
    def is_sorted(self) -> bool:
        return bool(self.sort_columns)


@dataclass(frozen=True)
class Insert:
    path: str
    table: str


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class SetOutput:
    """target is STDOUT, NONE or a path."""

    target: str


@dataclass(frozen=True)
class Quit:
    pass


Statement = Select | CreateTable | Insert | DropTable | SetOutput | Quit
