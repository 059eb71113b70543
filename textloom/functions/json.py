"""JSON held in text columns: canonical form, and fields of the wanted type or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys and whole floats as integers; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def _typed(text: Column, key: str, kind: str, shown: str) -> Column:
    v = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == shown, F.try_variant_get(v, "$", kind))


def string_field(text: Column, key: str) -> Column:
    return _typed(text, key, "string", "STRING")


def bool_field(text: Column, key: str) -> Column:
    return _typed(text, key, "boolean", "BOOLEAN")


def count_field(text: Column, key: str) -> Column:
    """A whole number from 0 to 2 ** 53 - 1."""
    n = _typed(text, key, "bigint", "BIGINT")
    return F.when((n >= 0) & (n <= (1 << 53) - 1), n)
