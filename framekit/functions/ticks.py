""".NET ticks (100 ns since 0001-01-01) to and from timestamps, Unix epochs and epoch nanoseconds.

All are Column expressions. Values that do not fit a long of nanoseconds become null on either side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tick format.
TICKS_PER_SECOND = 10_000_000
NANOS_PER_TICK = 100
UNIX_EPOCH_TICKS = 621355968000000000
# Largest and smallest ticks whose nanoseconds since 1970 fit a long.
MAX_NANO_TICKS = 713589688368547758
MIN_NANO_TICKS = UNIX_EPOCH_TICKS - (2**63 // NANOS_PER_TICK)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dotnet_ticks_to_unix_epoch(ticks: str | Column) -> Column:
    """Seconds since 1970 as a decimal."""
    return (_col(ticks).cast("decimal(19,0)") - UNIX_EPOCH_TICKS) / TICKS_PER_SECOND


def dotnet_ticks_to_timestamp(ticks: str | Column) -> Column:
    """Timestamp in microseconds; the last digit of the ticks is lost."""
    return dotnet_ticks_to_unix_epoch(ticks).cast("timestamp")


def dotnet_ticks_to_unix_epoch_nanos(ticks: str | Column) -> Column:
    """Nanoseconds since 1970 as a long, or null if they do not fit."""
    t = _col(ticks)
    return F.when(t.between(MIN_NANO_TICKS, MAX_NANO_TICKS), (t.cast("long") - F.lit(UNIX_EPOCH_TICKS)) * F.lit(NANOS_PER_TICK))


def timestamp_to_dotnet_ticks(timestamp: str | Column) -> Column:
    return F.unix_micros(_col(timestamp)) * F.lit(10) + F.lit(UNIX_EPOCH_TICKS)


def unix_epoch_to_dotnet_ticks(epoch: str | Column) -> Column:
    """From seconds as int, long, double, decimal or string."""
    return (_col(epoch).cast("decimal(19,7)") * TICKS_PER_SECOND).cast("long") + F.lit(UNIX_EPOCH_TICKS)


def unix_epoch_nanos_to_dotnet_ticks(nanos: str | Column) -> Column:
    """From nanoseconds as int, long, double, decimal or string."""
    return (_col(nanos).cast("decimal(21,0)") / NANOS_PER_TICK).cast("long") + F.lit(UNIX_EPOCH_TICKS)
