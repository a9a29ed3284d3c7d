"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries crossed from a to b (not elapsed time divided by a second)."""
    return epoch(b) - epoch(a)


def minutes_between(a: Column, b: Column) -> Column:
    return F.floor(epoch(b) / 60) - F.floor(epoch(a) / 60)


def hours_between(a: Column, b: Column) -> Column:
    return F.floor(epoch(b) / 3600) - F.floor(epoch(a) / 3600)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def block_of(ts: Column) -> Column:
    """The hour of an instant as a number: the blocks into which series are cut."""
    return F.floor(epoch(ts) / 3600)


def usable(quality: Column) -> Column:
    return quality >= 64


def trusted(quality: Column) -> Column:
    """Usable and not held: what statistics are computed from."""
    return usable(quality) & (quality != C.STALE)


def operating_state(current: Column, bands=C.STATE_BANDS) -> Column:
    """State band of a motor current; null current has no state."""
    a, b, c = bands
    return F.when(current < a, "OFF").when(current < b, "OFFLOADED").when(current < c, "LOADED").when(current.isNotNull(), "STARTING")


def with_states(readings: DataFrame, states: DataFrame | None) -> DataFrame:
    """Readings with the ``operating_state`` of their instant, of scans that are not held;
    without ``states`` the readings bring both, as ``analysis.stated`` gives them."""
    if states is None:
        return readings.where(~F.col("is_stale")).drop("is_stale")
    return readings.join(states.where(~F.col("is_stale")).select("reading_ts", "operating_state"), "reading_ts")


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def deviation_for_span(low: Column, high: Column, percent: float) -> Column:
    """Half-width of an error corridor as a share of a sensor's span; 0 for an empty span."""
    span = F.abs(high - low)
    return F.when(span > 0, span * (percent / 100.0)).otherwise(0.0)


def severity_by_z(z: Column) -> Column:
    return F.when(z >= C.ROBUST_Z_CRITICAL, "CRITICAL").otherwise("WARNING")


def status_reason(status: Column, critical: Column, warning: Column, hours: int = C.ACTIVE_HOURS) -> Column:
    """The sentence that explains an equipment status (fixed wording)."""
    count = lambda n, kind: F.concat(n.cast("string"), F.lit(f" {kind} anomal"), F.when(n == 1, "y").otherwise("ies"), F.lit(f" in the last {hours} hours of the archive."))
    return (
        F.when(status == "NO DATA", "No readings have been ingested for this equipment.")
        .when(critical > 0, count(critical, "critical"))
        .when(warning > 0, count(warning, "warning-level"))
        .otherwise(f"No anomalies in the last {hours} hours of the archive.")
    )


def is_identifier(text: Column) -> Column:
    """Whether a sensor reference is a number rather than a code."""
    return F.trim(text).rlike("^[0-9]+$")


def summary_by_wording(details: Column) -> Column:
    """Whether an issue row from before the summary flag existed is a summary, by its text."""
    return F.coalesce(details.like("Run total:%") | details.like("%was capped at%"), F.lit(False))
