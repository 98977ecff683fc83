"""Rounding and banding expressions shared by the dashboard and the model jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Churn risk band thresholds, applied to the unrounded probability,
# and the band names in severity order.
HIGH_RISK = 0.66
MEDIUM_RISK = 0.33
BAND_ORDER = ["High", "Medium", "Low"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_cents(x: Column | str) -> Column:
    """Round a double to cents, halves toward +infinity: floor(x * 100 + 0.5) / 100."""
    return (F.floor(_col(x) * 100 + 0.5) / 100).cast("double")


def avg_per_household(spend: Column | str, households: Column | str) -> Column:
    """Cents-rounded spend / households, rounded again; 0 when there are no households."""
    h = _col(households)
    return F.when(h > 0, round_cents(_col(spend) / h)).otherwise(F.lit(0.0))


def round4(x: Column | str) -> Column:
    """Four decimal places, halves away from zero on the decimal value."""
    return F.round(_col(x).cast("double"), 4)


def risk_band(probability: Column | str) -> Column:
    p = _col(probability)
    return (F.when(p >= HIGH_RISK, F.lit(BAND_ORDER[0]))
             .when(p >= MEDIUM_RISK, F.lit(BAND_ORDER[1]))
             .otherwise(F.lit(BAND_ORDER[2])))
