"""Column names that can't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores in front as make it no column of ``docs``."""
    taken = {x.lower() for x in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
