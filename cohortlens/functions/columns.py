"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import params as P

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _c(ts))


def epoch_seconds(ts) -> Column:
    """Whole seconds since the epoch, floored (also before 1970)."""
    # micros < 2**53, so the double quotient is exact enough for floor() to be exact
    return F.floor(epoch_micros(ts) / F.lit(1_000_000))


def seconds_between(earlier, later) -> Column:
    """Number of second boundaries between two instants (``later - earlier``).

    0.9 s -> 1.1 s counts 1, as warehouse ``date_diff(…, second)`` does; Spark's
    ``timestampdiff`` would count whole elapsed seconds and give 0.
    """
    return (epoch_seconds(later) - epoch_seconds(earlier)).cast("long")


def zone_or_default(zone) -> Column:
    """Trimmed zone name; null, blank or missing -> UTC."""
    return F.coalesce(F.nullif(F.trim(_c(zone)), F.lit("")), F.lit(P.DEFAULT_ZONE))


def local_time(ts_utc, zone) -> Column:
    """Wall-clock time in ``zone`` of a UTC TIMESTAMP_NTZ; stays TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), _c(zone), _c(ts_utc))


def event_label(event_name="event_name", action="action", page_type="page_type") -> Column:
    """event_name when there is no action, else 'action-page_type' (null if page_type is null)."""
    return F.when(_c(action).isNull(), _c(event_name)).otherwise(
        F.concat(_c(action), F.lit(P.LABEL_SEPARATOR), _c(page_type)))
