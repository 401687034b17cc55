"""Filters with actions of the caller's: a scan, a check of elements, and what it yields."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row

from ..functions import filters


def process(elements: DataFrame, chosen: list[filters.ElementFilter], action: Callable[[Row], None]) -> None:
    """Calls the action, on the executors, for each row (etype, id, tags, ...) that a filter takes; once for each that does."""

    def run(rows: Iterator[Row]) -> None:
        for row in rows:
            action(row)

    filters.select(elements, chosen).foreachPartition(run)


def validate(elements: DataFrame, chosen: list[filters.ElementFilter], check: Callable[[dict], str | None]) -> DataFrame:
    """(etype, id, reason) of rows that a filter takes and the check gives a reason for; each row once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r["etype"], r["id"], why) for r in pdf.to_dict("records") if (why := check(r)) is not None]
            yield pd.DataFrame(out, columns=["etype", "id", "reason"])

    taken = filters.select(elements, chosen).dropDuplicates(["etype", "id"])
    return taken.mapInPandas(run, "etype string, id long, reason string")
