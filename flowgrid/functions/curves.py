"""Model curves as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_law(x: Column, a, alpha) -> Column:
    return a * F.pow(x, alpha)


def exponential(x: Column, a, alpha) -> Column:
    return a * F.exp(alpha * x)


def linear(x: Column, a, b) -> Column:
    return a + b * x


def multilinear(logk, xs: list[Column], weights: list) -> Column:
    out = logk
    for x, w in zip(xs, weights):
        out = out + x * w
    return out


def lognormal_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-F.pow(F.ln(x) - mu, 2) / (2 * sigma**2)) / (x * sigma * math.sqrt(2 * math.pi))


def gamma_pdf(x: Column, shape: float, scale: float) -> Column:
    """Shape and scale are parameters, so the gamma function is of a number, not of a column."""
    return F.pow(x, shape - 1) * F.exp(-x / scale) / (math.gamma(shape) * scale**shape)


def weibull_pdf(x: Column, shape: float, scale: float) -> Column:
    return shape / scale * F.pow(x / scale, shape - 1) * F.exp(-F.pow(x / scale, shape))


def morlet(x: Column, sigma: float) -> Column:
    return F.exp(-x * x / 2) * F.cos(2 * math.pi * x / sigma)


def gravity(mi: Column, mj: Column, d: Column, k: float, alpha: float, gamma: float, inverse_d0: float) -> Column:
    return F.lit(k) * F.pow(mi, alpha) * F.pow(mj, gamma) * F.exp(d * inverse_d0)


def epsilon(r: Column, critical: Column) -> Column:
    """Relative distance of R squared from its critical value."""
    return F.try_divide(r * r - critical * critical, critical * critical)
