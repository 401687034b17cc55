"""What operators need of the session: checkpoints in the shared folder, and names that a table doesn't use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators._state import checkpoint, delete, drop, scope, shared_folder

__all__ = ["checkpoint", "delete", "drop", "scope", "shared_folder", "unused"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of the table has it."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
