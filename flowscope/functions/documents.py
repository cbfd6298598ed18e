"""Nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_value(value: Column, schema: T.DataType, path: list[str]) -> Column:
    """Walk a typed nested value by field names, stepping into the first element of any array on the way.

    A field the schema does not have gives null; a path that ends early at a scalar gives the scalar.
    """
    if not path:
        return value
    if isinstance(schema, T.ArrayType):
        return path_value(F.try_element_at(value, F.lit(1)), schema.elementType, path)
    if isinstance(schema, T.StructType):
        head, *rest = path
        if head not in schema.fieldNames():
            return F.lit(None)
        return path_value(value.getField(head), schema[head].dataType, rest)
    return value


def json_path(text: Column, path: list[str]) -> Column:
    """The same walk over JSON text whose path holds objects only, as a string."""
    return F.get_json_object(text, "$." + ".".join(path))
