"""Instants, civil dates and capture quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds before kickoff that still count as after it; hours before it that are late; minutes at which a line freezes.
EDGE_SECONDS, LATE_HOURS, FREEZE_MINUTES = 45, 3, 2
CIVIL_ZONE = "-03:00"


def parse_instant(text: Column, naive_zone: str = "+00:00") -> Column:
    """Instant from epoch seconds or milliseconds, ``/Date(ms)/``, ISO with Z, offset or none; null if none fits."""
    t = F.trim(text)
    digits = F.regexp_extract(t, r"^(?:/Date\()?(\d{9,14})(?:[+-]\d{4})?(?:\)/)?$", 1)
    number = F.when(digits != "", digits.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    minutes = F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})_(\d{2})(\d{2})$", "$1 $2:$3"), r"(\.\d{6})\d+", "$1")
    iso = F.regexp_replace(minutes, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & iso.rlike(r"\d{2}:\d{2}"), iso).otherwise(F.concat(iso, F.lit(naive_zone)))
    full = F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}[+-]"), F.regexp_replace(zoned, r"^(\d{4}-\d{2}-\d{2})", "$1T00:00:00")).otherwise(zoned)
    return F.coalesce(epoch, F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), full.try_cast("timestamp")))


def civil_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, CIVIL_ZONE))


def pre_kickoff(ts: Column, kickoff: Column) -> Column:
    """Strictly before kickoff less the edge; true where either is unknown."""
    return F.coalesce(ts < kickoff - F.expr(f"INTERVAL {EDGE_SECONDS} SECONDS"), F.lit(True))


def prematch(ts: Column, kickoff: Column) -> Column:
    """As pre_kickoff, but false where the time itself is unknown."""
    return ts.isNotNull() & pre_kickoff(ts, kickoff)


def freezes(now: Column, kickoff: Column) -> Column:
    return F.coalesce(now >= kickoff - F.expr(f"INTERVAL {FREEZE_MINUTES} MINUTES"), F.lit(False))


def capture_quality(open_ts: Column, close_odd: Column, close_ts: Column, kickoff: Column, status: Column) -> Column:
    edge = kickoff - F.expr(f"INTERVAL {EDGE_SECONDS} SECONDS")
    band = F.when(open_ts > kickoff - F.expr(f"INTERVAL {LATE_HOURS} HOURS"), "late_open").otherwise("full_prematch")
    return (
        F.when(kickoff.isNull() | open_ts.isNull(), "unknown")
        .when(open_ts >= edge, "post_kickoff")
        .when(F.coalesce(status, F.lit("open")) == "open", band)
        .when(F.coalesce(close_odd, F.lit(0.0)) == 0, "no_close")
        .when(close_ts.isNull() | (close_ts >= edge), "no_close")
        .otherwise(band)
    )


def strict_reason(status: Column, open_odd: Column, close_odd: Column, open_ts: Column, close_ts: Column, kickoff: Column, quality: Column) -> Column:
    """Why a line does not count for closing-line value; null if it does."""
    from larkspur.functions.prob import valid_odd

    edge = kickoff - F.expr(f"INTERVAL {EDGE_SECONDS} SECONDS")
    return (
        F.when(~status.eqNullSafe(F.lit("settled")), "not_settled")
        .when(~valid_odd(open_odd), "invalid_open")
        .when(~valid_odd(close_odd), "invalid_close")
        .when(kickoff.isNull(), "missing_kickoff")
        .when(open_ts.isNull(), "missing_open_ts")
        .when(close_ts.isNull(), "missing_close_ts")
        .when(open_ts >= edge, "open_not_prematch")
        .when(close_ts >= edge, "close_not_prematch")
        .when(~quality.isin("full_prematch", "late_open"), F.concat(F.lit("quality_"), quality))
    )


def age_bucket(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), "unknown").when(hours < 0, "not_started").when(hours < 24, "0-24h").when(hours < 72, "1-3d")
        .when(hours < 168, "3-7d").when(hours < 720, "7-30d").otherwise("30d+")
    )
