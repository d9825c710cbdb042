"""Text cells that hold several values, and booleans kept as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _literal_list(cell: Column) -> Column:
    """The list a ``[...]`` cell spells out, NULL if it is not a well-formed list."""
    text = F.trim(cell)
    return F.when(
        text.startswith("["),
        F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}),
    )


def _clean(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)


def parse_tags(cell: Column, pipe: bool = False) -> Column:
    """``array<string>`` from a list literal or a comma-separated cell.

    A malformed literal is treated as comma-separated text; blanks are dropped; NULL
    gives an empty array. With ``pipe``, ``|`` separates as well.
    """
    parts = F.split(cell, "[,|]" if pipe else ",")
    return F.coalesce(_clean(F.coalesce(_literal_list(cell), parts)), F.array().cast("array<string>"))


def parse_list_str(cell: Column) -> Column:
    """Like ``parse_tags`` but a cell that is no list literal is one element."""
    return (
        F.when(cell.startswith("[") & _literal_list(cell).isNotNull(), _literal_list(cell))
        .when(F.length(F.trim(cell)) > 0, F.array(cell))
        .otherwise(F.array().cast("array<string>"))
    )


def parse_flag(cell: Column) -> Column:
    """TRUE and 1 (any case, padded) are true; everything else, NULL included, is false."""
    return F.coalesce(F.upper(F.trim(cell.cast("string"))).isin("TRUE", "1"), F.lit(False))
