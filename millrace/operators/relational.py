"""The relational operators, each a function from DataFrames to a DataFrame.

Predicates and expressions may be text or syntax. The planner calls the same functions. All run on built-in Spark
operators, so filters and column choices reach the scan and Spark picks join and aggregation strategies.
"""

from __future__ import annotations

from functools import reduce
from typing import TextIO

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import QueryError
from millrace.functions.expressions import Scope, arithmetic, predicate, scope_of
from millrace.functions.parser import parse_cnf, parse_expression
from millrace.functions.syntax import Cnf, Comparison, Expression, Name
from millrace.sources.tables import print_rows, write_lines


def _cnf(cnf: str | Cnf) -> Cnf:
    return parse_cnf(cnf) if isinstance(cnf, str) else cnf


def _expression(expression: str | Expression) -> Expression:
    return parse_expression(expression) if isinstance(expression, str) else expression


def select_file(spark: SparkSession, path: str, cnf: str | Cnf = (), strict: bool = False) -> DataFrame:
    """The rows of a Parquet table that satisfy cnf; what Parquet can decide is pushed into the scan."""
    return select_pipe(spark.read.parquet(path), cnf, strict=strict)


def select_pipe(df: DataFrame, cnf: str | Cnf, scope: Scope | None = None, strict: bool = False) -> DataFrame:
    """The rows of df that satisfy cnf."""
    cnf = _cnf(cnf)
    return df.where(predicate(cnf, scope or scope_of(df.schema), strict)) if cnf else df


def project(df: DataFrame, columns: list[str | Column]) -> DataFrame:
    """Some columns, in the given order; repeated rows stay."""
    return df.select(*columns)


def join(left: DataFrame, right: DataFrame, cnf: str | Cnf = (), scope: Scope | None = None, strict: bool = False) -> DataFrame:
    """Inner join on cnf: by hash or sort-merge where it has an equality, else by nested loops; the product if empty.

    Where a disjunction of equalities between the sides is all there is to join along, it becomes a union of joins
    along each of them, each without the pairs of those before it. Without a scope, columns are named bare and must
    differ between the sides.
    """
    cnf = _cnf(cnf)
    if scope is None:
        both = set(left.columns) & set(right.columns)
        if both:
            raise QueryError(f"both sides have {', '.join(sorted(both))}; give aliases")
        scope = scope_of(type(left.schema)([*left.schema.fields, *right.schema.fields]))
    if not cnf:
        return left.crossJoin(right)
    across = lambda term: term.op == "=" and len(list(term.names())) == 2 and _parted(term, left, right, scope)
    either = next((terms for terms in cnf if len(terms) > 1 and all(map(across, terms))), None)
    if either is None or any(len(terms) == 1 and across(terms[0]) for terms in cnf):
        return left.join(right, predicate(cnf, scope, strict), "inner")
    rest = predicate(tuple(terms for terms in cnf if terms is not either), scope, strict)
    ways, before = [], F.lit(False)
    for term in either:
        equal = predicate(((term,),), scope, strict)
        ways.append(left.join(right, equal & ~before & rest, "inner"))
        before = before | F.coalesce(equal, F.lit(False))
    return reduce(DataFrame.union, ways)


def _parted(term: Comparison, left: DataFrame, right: DataFrame, scope: Scope) -> bool:
    """Whether one side of a comparison is a column of left and the other one of right."""
    found = [scope.column(name) for name in term.names()]
    return any(_has(a, found[0]) and _has(b, found[1]) for a, b in ((left, right), (right, left)))


def _has(df: DataFrame, column: Column) -> bool:
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def _sum(column: Column, distinct: bool) -> Column:
    return F.sum_distinct(column) if distinct else F.sum(column)


def sum_(df: DataFrame, expression: str | Expression, distinct: bool = False, scope: Scope | None = None) -> DataFrame:
    """One row with column "sum": a bigint for int expressions, else a double; 0 for no rows."""
    column, kind = arithmetic(_expression(expression), scope or scope_of(df.schema))
    zero = F.lit(0).cast("long") if kind == "int" else F.lit(0.0)
    return df.agg(F.coalesce(_sum(column, distinct), zero).alias("sum"))


def group_by(df: DataFrame, keys: list[str] | list[Column], expression: str | Expression, distinct: bool = False, scope: Scope | None = None) -> DataFrame:
    """One row a group: "sum", then the keys; no rows for no rows."""
    column, kind = arithmetic(_expression(expression), scope or scope_of(df.schema))
    grouped = df.groupBy(*keys).agg(_sum(column, distinct).alias("sum"))
    return grouped.select(F.col("sum"), *[c for c in grouped.columns if c != "sum"])


def duplicate_removal(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.distinct()


def sort(df: DataFrame, keys: list[str], ascending: bool = True) -> DataFrame:
    """All rows by keys, in one direction; Spark ranges, sorts and spills."""
    return df.orderBy(*[F.col(f"`{k}`").asc() if ascending else F.col(f"`{k}`").desc() for k in keys])


def sort_keys(cnf: str | Cnf, columns: list[str]) -> list[str]:
    """The sort keys that a predicate of equalities names, in its order."""
    out = []
    for terms in _cnf(cnf):
        if len(terms) == 1 and terms[0].op == "=":
            for side in (terms[0].left, terms[0].right):
                if isinstance(side, Name) and side.column in columns and side.column not in out:
                    out.append(side.column)
    return out


def write_out(df: DataFrame, path: str) -> int:
    """Write the rows as text lines; gives their number."""
    return write_lines(df, path)


def print_out(df: DataFrame, out: TextIO | None = None) -> int:
    """Print the rows for a console, doubles with six significant digits; gives their number."""
    return print_rows(df, out)
