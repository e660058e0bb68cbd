"""Settlement attempts: what has no result yet is tried again, and an unchanged failure is noted at most every six hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours between notes of the same failure, and the states that are tried again.
THROTTLE_HOURS = 6
RETRIED = ("closed", "pending_result")

STATE = ["status", "result", "reason", "retryable", "last_attempt", "attempts"]


def retryable() -> Column:
    """Closed and pending records, and unavailable ones unless they are marked as final."""
    return F.col("status").isin(*RETRIED) | ((F.col("status") == "unavailable") & F.coalesce(F.col("retryable"), F.lit(True)))


def attempt(records: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """Records(key, STATE) after a run at now with results(key, found double, why string): one row a key, why where nothing was found.

    A key without a row in results lacks a result. A null key matches nothing. Rows that are not retryable pass as they are.
    """
    found = results.select(F.col(key).alias("_key"), "found", "why")
    rows = records.join(found, records[key] == found["_key"], "left").drop("_key")
    tried, known = retryable(), F.col("found").isNotNull()
    why = F.coalesce("why", F.lit("missing_result"))
    changed = (F.col("status") != "pending_result") | ~F.col("reason").eqNullSafe(why) | ~F.coalesce(F.col("retryable"), F.lit(False))
    due = F.coalesce(now - F.col("last_attempt") >= F.expr(f"INTERVAL {THROTTLE_HOURS} HOURS"), F.lit(True))
    noted = tried & ~known & (changed | due)
    pick = lambda c, settled, pending: F.when(tried & known, settled).when(noted, pending).otherwise(F.col(c)).alias(c)
    others = [c for c in records.columns if c not in STATE]
    return rows.select(
        *others, pick("status", F.lit("settled"), F.lit("pending_result")), pick("result", F.col("found"), F.lit(None).cast("double")), pick("reason", F.lit(None).cast("string"), why),
        pick("retryable", F.lit(False), F.lit(True)), pick("last_attempt", now, now), pick("attempts", F.coalesce("attempts", F.lit(0)) + 1, F.coalesce("attempts", F.lit(0)) + 1),
    )
