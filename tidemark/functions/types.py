"""Result types of the array functions, usable before a session exists."""

from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
