"""JSON text columns: paths, and comparison by the operand's type."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(column: Column, path: list[str]) -> Column:
    """The value at the path as text; null if missing or JSON null. A number may be an index or an object's key."""
    steps = [[f"[{p}]", f"['{p}']"] if p.isdigit() else [f"['{p}']"] for p in path]
    found = [F.get_json_object(column, "$" + "".join(s)) for s in product(*steps)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def as_text(value: object) -> object:
    """A Python value as JSON text shows it."""
    return value if value is None or isinstance(value, str) else "true" if value is True else "false" if value is False else str(value)


def typed(text: Column, operand: object) -> Column:
    """JSON text cast to what the operand is; a text that can't be cast is null."""
    if isinstance(operand, bool):
        return text.try_cast("boolean")
    if isinstance(operand, (int, float)):
        return text.try_cast("double")
    return text
