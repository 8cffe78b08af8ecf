"""Small predicates of ledgers and sources as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Whether a version's first two parts, as whole numbers, reach major.minor; false where they aren't numbers.

    A version of one part is below the same major with any minor.
    """
    parts = F.transform(F.slice(F.split(version, r"\."), 1, 2), lambda x: x.try_cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    numbers = ~F.exists(parts, lambda x: x.isNull())
    return F.coalesce(numbers & ((a > major) | ((a == major) & F.coalesce(b >= minor, F.lit(False)))), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9A-Fa-f]{64}\z"), F.lit(False))


def from_host(url: Column, host: str) -> Column:
    """Whether a URL is https and of the host or a part of it."""
    name = F.lower(F.parse_url(url, F.lit("HOST")))
    return F.coalesce((F.parse_url(url, F.lit("PROTOCOL")) == "https") & ((name == host) | name.endswith("." + host)), F.lit(False))


def recording_open(target: Column, now: Column, *, cutoff: str = "20:15:00", zone: str = "Europe/Paris") -> Column:
    """Whether a forecast for the target date may still be recorded at the instant now: before the cutoff of that day there."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")))
    return local < F.to_timestamp_ntz(F.concat(F.date_format(target, "yyyy-MM-dd"), F.lit(f" {cutoff}")))


def same_number(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Equal within the tolerance, relative to the larger or absolute."""
    near = F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return F.coalesce(F.abs(a - b) <= near, F.lit(False)) | (a == b)


def share_factor(rate: Column) -> Column:
    """The expected share of a prize with a Poisson number of other winners: 1 at 0."""
    return F.when(rate == 0, F.lit(1.0)).otherwise(-F.expm1(-rate) / rate)


def nearest_quantile(ordered: Column, probability: float) -> Column:
    """The value of an ascending array at the nearest place, halves going to the even one."""
    return F.get(ordered, F.bround(probability * (F.size(ordered) - 1), 0).cast("int"))
