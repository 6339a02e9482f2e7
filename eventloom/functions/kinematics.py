"""Angles, distances and four-vectors as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def delta_phi(a: Column, b: Column) -> Column:
    """``a - b`` wrapped into (-pi, pi]."""
    d = a - b
    return d - F.lit(TWO_PI) * F.ceil((d - math.pi) / TWO_PI)


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    deta = eta1 - eta2
    dphi = delta_phi(phi1, phi2)
    return F.sqrt(deta * deta + dphi * dphi)


def folded_delta_r(
    eta1: Column, phi1: Column, eta2: Column, phi2: Column, pi: float = math.pi, full: float | None = None
) -> Column:
    """Distance with the absolute angle folded at ``pi``.

    ``full`` is the full turn that goes with ``pi``; rounded constants such as
    3.1416 / 6.2832 reproduce results made with them.
    """
    full = 2.0 * pi if full is None else full
    gap = F.abs(phi1 - phi2)
    gap = F.when(gap > pi, F.lit(full) - gap).otherwise(gap)
    deta = eta1 - eta2
    return F.sqrt(deta * deta + gap * gap)


def energy(pt: Column, eta: Column, mass: Column) -> Column:
    p = pt * F.cosh(eta)
    return F.sqrt(p * p + mass * mass)


def p4_from_mass(pt: Column, eta: Column, phi: Column, mass: Column) -> Column:
    """STRUCT<px, py, pz, e> from transverse momentum, angles and mass."""
    return F.struct(
        (pt * F.cos(phi)).alias("px"),
        (pt * F.sin(phi)).alias("py"),
        (pt * F.sinh(eta)).alias("pz"),
        energy(pt, eta, mass).alias("e"),
    )


def p4_from_energy(pt: Column, eta: Column, phi: Column, e: Column) -> Column:
    return F.struct(
        (pt * F.cos(phi)).alias("px"),
        (pt * F.sin(phi)).alias("py"),
        (pt * F.sinh(eta)).alias("pz"),
        e.cast("double").alias("e"),
    )


def pair_mass(a: Column, b: Column, unit: float = 1.0) -> Column:
    """Invariant mass of two four-vectors in multiples of ``unit``; a negative
    square from rounding counts as zero."""
    e = a["e"] + b["e"]
    px, py, pz = a["px"] + b["px"], a["py"] + b["py"], a["pz"] + b["pz"]
    m = F.sqrt(F.greatest(e * e - (px * px + py * py + pz * pz), F.lit(0.0)))
    return m if unit == 1.0 else m / unit


def eta_of(px: Column, py: Column, pz: Column) -> Column:
    """Pseudo-rapidity from stored momentum components."""
    return F.asinh(pz / F.sqrt(px * px + py * py))
