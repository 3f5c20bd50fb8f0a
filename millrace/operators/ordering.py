"""Sort keys with direction and null placement, shared by sorts, windows and dedup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sort:
    """One sort key. ``nulls`` is "first" or "last"; unset means Spark's default for the direction."""

    column: str
    direction: str = "asc"
    nulls: str | None = None

    @property
    def descending(self) -> bool:
        return self.direction.lower() == "desc"

    @property
    def nulls_first(self) -> bool:
        if self.nulls is None:
            return not self.descending
        return self.nulls.lower() == "first"

    def reversed(self) -> Sort:
        return Sort(self.column, "asc" if self.descending else "desc", "last" if self.nulls_first else "first")

    def to_column(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


SortLike = str | tuple | Sort


def as_sorts(keys: SortLike | Sequence[SortLike]) -> list[Sort]:
    """Accepts "col", ("col", "desc"), ("col", "desc", "first") or ``Sort``."""
    if isinstance(keys, (str, Sort)) or (isinstance(keys, tuple) and keys and isinstance(keys[0], str)
                                         and len(keys) > 1 and str(keys[1]).lower() in ("asc", "desc")):
        keys = [keys]
    return [k if isinstance(k, Sort) else Sort(k) if isinstance(k, str) else Sort(*k) for k in keys]


def sort_columns(keys) -> list[Column]:
    return [s.to_column() for s in as_sorts(keys)]
