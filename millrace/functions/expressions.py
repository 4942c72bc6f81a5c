"""Syntax bound to columns: name resolution, types, predicates and arithmetic as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import QueryError

from .syntax import Arithmetic, Cnf, Comparison, Disjunction, Expression, Literal, Name, Negate


def kind_of(type_: T.DataType) -> str:
    """int, double, string or time."""
    if isinstance(type_, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(type_, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(type_, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(type_, T.StringType):
        return "string"
    raise QueryError(f"columns of type {type_.simpleString()} are not supported in predicates or sums")


@dataclass(frozen=True)
class Scope:
    """What names mean: the schema behind each alias."""

    schemas: dict[str, T.StructType]

    def resolve(self, name: Name) -> Name:
        """name with its alias; unknown and ambiguous names are errors."""
        owners = [a for a, schema in self.schemas.items() if name.alias in (None, a) and name.column in schema.fieldNames()]
        if len(owners) != 1:
            raise QueryError(f"{'ambiguous' if owners else 'unknown'} column {name}")
        return Name(name.column, owners[0])

    def type_of(self, name: Name) -> T.DataType:
        found = self.resolve(name)
        return self.schemas[found.alias][found.column].dataType

    def column(self, name: Name) -> Column:
        found = self.resolve(name)
        return F.col(f"`{found.alias}`.`{found.column}`" if found.alias else f"`{found.column}`")

    def aliases(self, terms: Disjunction) -> frozenset[str]:
        return frozenset(self.resolve(n).alias for c in terms for n in c.names())


def scope_of(schema: T.StructType, alias: str = "") -> Scope:
    """The scope of one frame, whose columns are named bare."""
    return Scope({alias: schema})


def _operand(side: Name | Literal, scope: Scope) -> tuple[Column, str]:
    if isinstance(side, Literal):
        return F.lit(side.value), side.kind
    return scope.column(side), kind_of(scope.type_of(side))


def comparison(term: Comparison, scope: Scope, strict: bool = False) -> Column:
    """A comparison; strings only compare with strings and, as ISO text, with times. strict also parts ints from doubles."""
    (left, a), (right, b) = _operand(term.left, scope), _operand(term.right, scope)
    if a != b:
        numbers = {a, b} == {"int", "double"}
        times = {a, b} == {"string", "time"} and isinstance(term.left if a == "string" else term.right, Literal)
        if not (times or numbers and not strict):
            raise QueryError(f"{term}: {a} does not compare with {b}")
        if times:
            named = term.right if a == "string" else term.left
            left, right = (left.cast(scope.type_of(named)), right) if a == "string" else (left, right.cast(scope.type_of(named)))
    return left < right if term.op == "<" else left > right if term.op == ">" else left == right


def disjunction(terms: Disjunction, scope: Scope, strict: bool = False) -> Column:
    return reduce(Column.__or__, (comparison(t, scope, strict) for t in terms))


def predicate(cnf: Cnf, scope: Scope, strict: bool = False) -> Column:
    """The conjunction; an empty one is true."""
    return reduce(Column.__and__, (disjunction(terms, scope, strict) for terms in cnf), F.lit(True))


def arithmetic(expression: Expression, scope: Scope) -> tuple[Column, str]:
    """A column and its kind: int if every leaf is an int (computed as bigint), else double."""
    if isinstance(expression, Literal):
        if expression.kind == "string":
            raise QueryError("a string has no place in arithmetic")
        return F.lit(expression.value).cast("long" if expression.kind == "int" else "double"), expression.kind
    if isinstance(expression, Name):
        kind = kind_of(scope.type_of(expression))
        if kind not in ("int", "double"):
            raise QueryError(f"{expression} is no number")
        return scope.column(expression).cast("long" if kind == "int" else "double"), kind
    if isinstance(expression, Negate):
        inner, kind = arithmetic(expression.operand, scope)
        return -inner, kind
    assert isinstance(expression, Arithmetic)
    (left, a), (right, b) = arithmetic(expression.left, scope), arithmetic(expression.right, scope)
    kind = "int" if a == b == "int" else "double"
    if kind == "double":
        left, right = left.cast("double"), right.cast("double")
    if expression.op == "/":
        return (F.call_function("div", left, right) if kind == "int" else left / right), kind
    return {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[expression.op](left, right), kind
