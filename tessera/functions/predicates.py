"""WHERE trees to Columns, over typed columns (structs) or a VARIANT body. Predicates are two-valued: a missing path is false, and NOT flips it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.where import And, Compare, Exists, Expr, In, Literal, Not, Or, parse_where


@dataclass(frozen=True)
class Typed:
    """Paths are columns or struct fields; a null is a missing value, as a typed table has no JSON null."""

    schema: T.StructType

    def _kind(self, path: str) -> T.DataType | None:
        at: T.DataType = self.schema
        for part in path.split("."):
            if not isinstance(at, T.StructType) or part not in at.fieldNames():
                return None
            at = at[part].dataType
        return at

    @staticmethod
    def _column(path: str) -> Column:
        head, *rest = path.split(".")
        c = F.col(f"`{head}`")
        for part in rest:
            c = c.getField(part)
        return c

    @staticmethod
    def _literal_fits(kind: T.DataType, value: Literal) -> bool:
        if isinstance(value, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(value, str):
            return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
        return value is not None and isinstance(kind, T.NumericType)

    def fits(self, path: str, value: Literal) -> bool:
        """Whether the path's type can equal the value at all."""
        kind = self._kind(path)
        return kind is not None and self._literal_fits(kind, value)

    def equals(self, path: str, value: Literal) -> Column:
        return self._column(path) == F.lit(value) if self.fits(path, value) else F.lit(False)

    def ordered(self, path: str, op: str, value: float) -> Column:
        kind = self._kind(path)
        if not isinstance(kind, T.NumericType):
            return F.lit(False)
        c = self._column(path)
        return {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]

    def contains(self, path: str, value: Literal) -> Column:
        kind = self._kind(path)
        if not isinstance(kind, T.ArrayType) or not self._literal_fits(kind.elementType, value):
            return F.lit(False)
        return F.array_contains(self._column(path), F.lit(value).cast(kind.elementType) if isinstance(value, str | bool) else F.lit(value))

    def exists(self, path: str) -> Column:
        return F.lit(False) if self._kind(path) is None else self._column(path).isNotNull()


_NUMBER, _STRING, _BOOLEAN, _ARRAY = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "^STRING", "^BOOLEAN", "^ARRAY"


@dataclass(frozen=True)
class Variant:
    """Paths are looked up in a VARIANT column. The stored type is checked first: casts alone would take "5" for a number."""

    body: str = "body"

    def _at(self, path: str) -> Column:
        return F.try_variant_get(F.col(self.body), "$." + path, "variant")

    @staticmethod
    def _same(v: Column, value: Literal) -> Column:
        kind = F.schema_of_variant(v)
        if value is None:
            return F.is_variant_null(v)
        if isinstance(value, bool):
            return F.when(kind.rlike(_BOOLEAN), F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, str):
            return F.when(kind.rlike(_STRING), F.try_variant_get(v, "$", "string") == value)
        return F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double") == float(value))

    def equals(self, path: str, value: Literal) -> Column:
        return self._same(self._at(path), value)

    def ordered(self, path: str, op: str, value: float) -> Column:
        v = self._at(path)
        c = F.when(F.schema_of_variant(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double"))
        return {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]

    def contains(self, path: str, value: Literal) -> Column:
        items = F.try_variant_get(F.col(self.body), "$." + path, "array<variant>")
        return F.when(F.schema_of_variant(self._at(path)).rlike(_ARRAY), F.exists(items, lambda x: F.coalesce(self._same(x, value), F.lit(False))))

    def exists(self, path: str) -> Column:
        return self._at(path).isNotNull()


def compile_where(expr: Expr | str, of: Typed | Variant) -> Column:
    """A Column that is never null."""
    if isinstance(expr, str):
        expr = parse_where(expr)
    sure = lambda c: F.coalesce(c, F.lit(False))
    match expr:
        case And(a, b):
            return compile_where(a, of) & compile_where(b, of)
        case Or(a, b):
            return compile_where(a, of) | compile_where(b, of)
        case Not(a):
            return ~compile_where(a, of)
        case Exists(path):
            return sure(of.exists(path))
        case In(path, values):
            out = sure(of.equals(path, values[0]))
            for v in values[1:]:
                out = out | sure(of.equals(path, v))
            return out
        case Compare(path, "=", value):
            return sure(of.equals(path, value))
        case Compare(path, "!=", value):
            return ~sure(of.equals(path, value))
        case Compare(path, "CONTAINS", value):
            return sure(of.contains(path, value))
        case Compare(path, op, value):
            return sure(of.ordered(path, op, value))
    raise TypeError(expr)


def filter_condition(expr: Expr | str, of: Typed | Variant) -> Column:
    """A Column that keeps the same rows in a filter, where null is as good as false.

    Without the guards that make compile_where's Columns never null, comparisons on typed columns reach the
    scan. Under NOT the guards stay.
    """
    if isinstance(expr, str):
        expr = parse_where(expr)
    match expr:
        case And(a, b):
            return filter_condition(a, of) & filter_condition(b, of)
        case Or(a, b):
            return filter_condition(a, of) | filter_condition(b, of)
        case Exists(path):
            return of.exists(path)
        case In(path, values):
            out = of.equals(path, values[0])
            for v in values[1:]:
                out = out | of.equals(path, v)
            return out
        case Compare(path, "=", value):
            return of.equals(path, value)
        case Compare(path, "!=", value) if isinstance(of, Typed) and of.fits(path, value):
            c = of._column(path)
            return c.isNull() | (c != F.lit(value))
        case Compare(path, ">" | ">=" | "<" | "<=" as op, value):
            return of.ordered(path, op, value)
        case Compare(path, "CONTAINS", value):
            return of.contains(path, value)
    return compile_where(expr, of)


def where(df: DataFrame, expr: Expr | str, body: str | None = None) -> DataFrame:
    """Rows of df that meet the expression, on typed columns or, with `body`, on that VARIANT column."""
    return df.where(filter_condition(expr, Variant(body) if body else Typed(df.schema)))
