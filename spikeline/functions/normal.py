"""Normal-quantile arithmetic on a handful of scalars, on the driver."""

from __future__ import annotations

from statistics import NormalDist

STANDARD = NormalDist()


def mde(standard_error: float, power: float, alpha: float = 0.05) -> float:
    """The least effect that a one-sided test at alpha finds with this power."""
    return (STANDARD.inv_cdf(1 - alpha) + STANDARD.inv_cdf(power)) * standard_error


def achieved_power(effect: float, standard_error: float, alpha: float = 0.05) -> float:
    return STANDARD.cdf(effect / standard_error - STANDARD.inv_cdf(1 - alpha))
