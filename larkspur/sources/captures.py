"""What a capture wrote, measured while it was written, and whether it counts as a success."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.keys import error_class

#: Games that must have been fetched for none of them having data to mean a changed format.
FETCHED_LEAST = 5


class FormatChanged(RuntimeError):
    """A feed was fetched and held nothing that reads."""


def observed(rows: DataFrame, write: Callable[[DataFrame], None], house: str, houses: list[str], data: Column) -> dict[str, tuple[int, int]]:
    """Write rows and return, for each house, how many rows it had and how many of them held data: counted by the write itself."""
    seen = Observation()
    counts = [F.count_if(F.col(house) == h).alias(f"n{k}") for k, h in enumerate(houses)]
    with_data = [F.count_if((F.col(house) == h) & F.coalesce(data, F.lit(False))).alias(f"d{k}") for k, h in enumerate(houses)]
    write(rows.observe(seen, *counts, *with_data))
    return {h: (seen.get[f"n{k}"], seen.get[f"d{k}"]) for k, h in enumerate(houses)}


def guard(fetched: int, with_data: int, least: int = FETCHED_LEAST) -> None:
    """Refuse a capture in which many games were fetched and none holds data."""
    if fetched >= least and with_data == 0:
        raise FormatChanged(f"parse: none of {fetched} games fetched holds data; has the format changed?")


def finished(spark: SparkSession, seen: dict[str, tuple[int, int]], min_events: int, mode: str = "full") -> DataFrame:
    """Status of each house: (house, ok, n_events, n_fetched, mode, error, error_class, exit_code); a failure is soft, it exits with 2."""
    rows = []
    for house, (fetched, with_data) in seen.items():
        error = None
        try:
            guard(fetched, with_data)
        except FormatChanged as changed:
            error = str(changed)[:300]
        rows.append((house, error is None and with_data >= min_events, with_data, fetched, mode, error))
    status = spark.createDataFrame(rows, "house string, ok boolean, n_events long, n_fetched long, mode string, error string")
    return status.withColumns({"error_class": error_class(F.col("error")), "exit_code": F.when(F.col("ok"), 0).otherwise(2)})
