"""Column expressions over the graph's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(prefix: str = "") -> Column:
    """What queries print for a node: its pretty name where it has one, else its symbol."""
    return F.coalesce(F.col(f"{prefix}username"), F.col(f"{prefix}name"))


def described(location: bool = True) -> Column:
    """name, name (file) or name (file:line)."""
    place = F.when(F.col("line").isNotNull(), F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
    named = display()
    return F.when(F.col("file").isNotNull(), F.concat(named, F.lit(" ("), place, F.lit(")"))).otherwise(named) if location else named


def kind(is_call: Column | str = "is_call") -> Column:
    """call or ref; an edge that isn't there counts as ref."""
    return F.when(F.col(is_call) if isinstance(is_call, str) else is_call, "call").otherwise("ref")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))
