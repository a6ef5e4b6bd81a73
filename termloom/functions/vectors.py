"""Column functions on vectors, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for missing, empty, unequal or zero vectors. Known norms can be passed in."""
    norm_a = norm(a) if norm_a is None else norm_a
    norm_b = norm(b) if norm_b is None else norm_b
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm_a > 0) & (norm_b > 0)
    return F.when(usable, dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0))


def has_vector(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False))


def vector_from_json(text: Column) -> Column:
    """A JSON array as a vector: numbers are kept, any other element is 0.0, any other value is NULL."""
    numeric = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    parsed = F.try_parse_json(text)
    return F.transform(
        parsed.try_cast("array<variant>"),
        lambda x: F.when(
            F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0).isin(*numeric),
            F.coalesce(x.try_cast("double"), F.lit(0.0)),
        ).otherwise(F.lit(0.0)),
    )
