"""Payload fields: paths such as `a.b` and `items[].price` over typed columns or over one VARIANT column.

A field with several values meets a condition if any of its values does.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "double" if isinstance(value, (int, float)) else "string"


def _inside(items: Column, name: str) -> Column:
    return F.transform(items, lambda e: e.getField(name))


class Scope:
    """Where fields are looked up. The collection gives the test of ids and the vector columns; nested scopes have
    neither."""

    def __init__(self, ids: Callable[[tuple], Column] | None = None, vectors: dict[str, Column] | None = None):
        self.ids, self.vectors = ids, vectors or {}

    def any(self, path: str, kind: str, condition: Callable[[Column], Column]) -> Column:
        """Whether a value of the kind meets the condition."""
        raise NotImplementedError

    def number(self, path: str) -> Column:
        raise NotImplementedError

    def text(self, path: str) -> Column:
        raise NotImplementedError

    def seconds(self, path: str) -> Column:
        raise NotImplementedError

    def null(self, path: str) -> Column:
        raise NotImplementedError

    def count(self, path: str) -> Column:
        """Number of values: the length of a list, 1 for another value, 0 for null and missing."""
        raise NotImplementedError

    def empty(self, path: str) -> Column:
        return self.count(path) == 0

    def any_geo(self, path: str, condition: Callable[[Column, Column], Column]) -> Column:
        raise NotImplementedError

    def any_object(self, path: str, condition: Callable[[Scope], Column]) -> Column:
        raise NotImplementedError


class TypedScope(Scope):
    def __init__(self, schema: T.StructType, base: Column | None = None, **more: Any):
        super().__init__(**more)
        self.schema, self.base = schema, base

    def find(self, path: str) -> tuple[Column, T.DataType] | None:
        at, kind = self.base, self.schema
        for part in path.split("."):
            name = part.removesuffix("[]")
            many = isinstance(kind, T.ArrayType)
            inner = kind.elementType if many else kind
            if not isinstance(inner, T.StructType) or name not in inner.names:
                return None
            found = inner[name].dataType
            if at is None:
                at = F.col(f"`{name}`")
            elif many:
                at = _inside(at, name)
                if isinstance(found, T.ArrayType):
                    at, found = F.flatten(at), found.elementType
                found = T.ArrayType(found)
            else:
                at = at.getField(name)
            kind = found
        return at, kind

    @staticmethod
    def _cast(value: Column, kind: T.DataType, want: str) -> Column | None:
        """The value as the kind of a literal, or None if it never equals one."""
        if want == "boolean":
            return value if isinstance(kind, T.BooleanType) else None
        if want == "double":
            return value if isinstance(kind, NUMBERS) else None
        if want == "timestamp":
            return value if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None
        return value if isinstance(kind, T.StringType) else None

    def any(self, path: str, kind: str, condition: Callable[[Column], Column]) -> Column:
        found = self.find(path)
        if found is None:
            return F.lit(False)
        at, own = found
        many = isinstance(own, T.ArrayType)
        inner = own.elementType if many else own
        if self._cast(at, inner, kind) is None:
            return F.lit(False)
        return F.exists(at, condition) if many else condition(at)

    def is_time(self, path: str) -> bool:
        found = self.find(path)
        kind = found and (found[1].elementType if isinstance(found[1], T.ArrayType) else found[1])
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def _first(self, path: str) -> tuple[Column, T.DataType]:
        found = self.find(path)
        if found is None:
            return F.lit(None), T.NullType()
        return (F.get(found[0], F.lit(0)), found[1].elementType) if isinstance(found[1], T.ArrayType) else found

    def number(self, path: str) -> Column:
        at, kind = self._first(path)
        return at.cast("double") if isinstance(kind, (*NUMBERS, T.BooleanType)) else F.lit(None).cast("double")

    def text(self, path: str) -> Column:
        return self._first(path)[0].cast("string")

    def seconds(self, path: str) -> Column:
        at, kind = self._first(path)
        return F.unix_micros(F.try_to_timestamp(at) if isinstance(kind, T.StringType) else at.cast("timestamp")) / F.lit(1e6)

    def null(self, path: str) -> Column:
        found = self.find(path)
        return F.lit(False) if found is None else found[0].isNull()

    def count(self, path: str) -> Column:
        found = self.find(path)
        if found is None:
            return F.lit(0)
        return F.coalesce(F.size(found[0]), F.lit(0)) if isinstance(found[1], T.ArrayType) else F.when(found[0].isNull(), 0).otherwise(1)

    def any_geo(self, path: str, condition: Callable[[Column, Column], Column]) -> Column:
        found = self.find(path)
        kind = found and (found[1].elementType if isinstance(found[1], T.ArrayType) else found[1])
        if not isinstance(kind, T.StructType) or not {"lat", "lon"} <= set(kind.names):
            return F.lit(False)
        test = lambda p: condition(p.getField("lat"), p.getField("lon"))
        return F.exists(found[0], test) if isinstance(found[1], T.ArrayType) else test(found[0])

    def any_object(self, path: str, condition: Callable[[Scope], Column]) -> Column:
        found = self.find(path.removesuffix("[]"))
        kind = found and (found[1].elementType if isinstance(found[1], T.ArrayType) else found[1])
        if not isinstance(kind, T.StructType):
            return F.lit(False)
        inside = lambda e: condition(TypedScope(kind, e))
        return F.exists(found[0], inside) if isinstance(found[1], T.ArrayType) else inside(found[0])


class VariantScope(Scope):
    def __init__(self, base: Column, **more: Any):
        super().__init__(**more)
        self.base = base

    def _value(self, path: str, kind: str) -> Column:
        plain = "$" + "".join(f"['{p.removesuffix('[]')}']" for p in path.split("."))
        return F.try_variant_get(self.base, plain, kind)

    def _each(self, path: str, kind: str) -> Column | None:
        """The values behind the last [] of a path, or None if it has none."""
        if "[]." not in path:
            return None
        head, tail = path.rsplit("[].", 1)
        return F.transform(self._value(head, "array<variant>"), lambda e: F.try_variant_get(e, "$" + "".join(f"['{p}']" for p in tail.split(".")), kind))

    def any(self, path: str, kind: str, condition: Callable[[Column], Column]) -> Column:
        each = self._each(path, "variant")
        many = each if each is not None else self._value(path, "array<variant>")
        one = self._value(path, "variant")
        fits = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT", "DECIMAL")}[kind]
        shape = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin(*fits)
        test = lambda v: F.coalesce(shape(v) & condition(F.try_variant_get(v, "$", kind)), F.lit(False))
        listed = F.coalesce(F.exists(many, test), F.lit(False))
        return listed if each is not None else listed | test(one)

    def number(self, path: str) -> Column:
        return self._value(path, "double")

    def text(self, path: str) -> Column:
        return self._value(path, "string")

    def seconds(self, path: str) -> Column:
        return F.unix_micros(F.try_to_timestamp(self._value(path, "string"))) / F.lit(1e6)

    def null(self, path: str) -> Column:
        return F.coalesce(F.is_variant_null(self._value(path, "variant")), F.lit(False))

    def count(self, path: str) -> Column:
        one, many = self._value(path, "variant"), self._value(path, "array<variant>")
        return F.when(one.isNull() | F.is_variant_null(one), 0).otherwise(F.coalesce(F.size(many), F.lit(1)))

    def any_geo(self, path: str, condition: Callable[[Column, Column], Column]) -> Column:
        test = lambda v: condition(F.try_variant_get(v, "$.lat", "double"), F.try_variant_get(v, "$.lon", "double"))
        return F.coalesce(test(self._value(path, "variant")), F.lit(False)) | F.coalesce(F.exists(self._value(path, "array<variant>"), test), F.lit(False))

    def any_object(self, path: str, condition: Callable[[Scope], Column]) -> Column:
        inside = lambda e: condition(VariantScope(e))
        return F.coalesce(F.exists(self._value(path.removesuffix("[]"), "array<variant>"), inside), F.lit(False))
