"""Typed access to tag values, which are JSON literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag types in the order in which a common type is looked for.
TAG_TYPES = ("int", "float", "string", "boolean", "mixed")


def tag_type(value: Column) -> Column:
    """int, float, string, boolean, or mixed for anything nested."""
    return (
        F.when(value.rlike(r"^-?[0-9]+$"), "int")
        .when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "float")
        .when(value.rlike(r'^"'), "string")
        .when(value.isin("true", "false"), "boolean")
        .otherwise("mixed")
    )


def tag_text(value: Column) -> Column:
    """The text of a string tag, NULL for other types."""
    return F.when(tag_type(value) == "string", F.from_json(
        F.concat(F.lit('{"v":'), value, F.lit("}")), "v string"
    )["v"])
