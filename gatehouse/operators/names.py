"""Names of columns that operators add for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(rows: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of rows is called so."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
