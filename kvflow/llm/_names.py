"""Column names beside a table's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, *tables: DataFrame) -> str:
    """``name`` with as many underscores behind it as it takes to differ from every column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(table: DataFrame) -> list[Column]:
    """All columns of a table, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in table.columns]
