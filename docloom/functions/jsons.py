"""Strict reading of JSON texts through VARIANT: types are not converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """A VARIANT, or null where the text is not JSON.

    Spark's parser stops after the first value, so the text is parsed as the first
    element of a list whose second and last is the text's own hash: what ends the list
    before it, or adds to it, does not give that hash.
    """
    mark = F.md5(c.cast("binary"))
    both = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')))
    return F.transform(F.array(both), lambda v: F.when((F.try_variant_get(v, "$[1]", "string") == mark) & F.try_variant_get(v, "$[2]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))[0]


def kind(v: Column, path: str = "$") -> Column:
    """The type of the value at a path, in Spark's names, such as STRING or BIGINT; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """A JSON string's text; null for any other type, so 5 does not become '5'."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(kind(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path).startswith("ARRAY"), F.lit(False))


def is_null(v: Column, path: str) -> Column:
    """Absent, or JSON's null."""
    return F.coalesce(kind(v, path) == "VOID", F.lit(True))


def compact_json(c: Column) -> Column:
    """A struct as JSON without its null fields."""
    return F.to_json(c)
