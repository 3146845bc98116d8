"""Schemas without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def fields(text: str) -> T.StructType:
    """``"a string, b long, c long[]"`` as a StructType."""
    out = T.StructType()
    for item in text.split(","):
        name, kind = item.split()
        out.add(name, T.ArrayType(_KINDS[kind[:-2]]) if kind.endswith("[]") else _KINDS[kind])
    return out
