"""Lookups in JSON texts of metadata that may be absent, broken or no object: then nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text) -> Column:
    """Map from name to variant of a text that is a whole JSON object, else null.

    The whole text is read: a text cut short gives nothing, also for names before the cut.  A name
    that is there twice makes the text a broken one.
    """
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def text_at(object_: Column, name: str) -> Column:
    """The value of a name as text, objects and arrays as JSON with sorted names; null for JSON null."""
    return F.try_variant_get(object_[name], "$", "string")


def number_at(object_: Column, name: str, type_: str = "decimal(28,2)") -> Column:
    """The value of a name if it is a JSON number: a number within quotes, or true, is none."""
    value = object_[name]
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", type_))
