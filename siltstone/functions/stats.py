"""Column expressions for statistics that the engine lacks or defines differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_lower(hits: str, total: str, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval for ``hits`` of ``total``."""
    p = f"({hits} / {total})"
    return F.expr(f"CASE WHEN {total} > 0 THEN ({p} + {z * z / 2}D / {total} - {z}D * sqrt(({p} * (1 - {p}) + {z * z / 4}D / {total}) / {total})) / (1 + {z * z}D / {total}) END")


def chi2_tail_8(x: str) -> Column:
    """Upper tail of chi-square with eight degrees of freedom, in closed form."""
    h = f"({x} / 2)"
    return F.expr(f"exp(-{h}) * (1 + {h} + pow({h}, 2) / 2 + pow({h}, 3) / 6)")


def log_gamma(z: str) -> str:
    """SQL of the logarithm of the gamma function for ``z > 0``, by Stirling's series eight steps up."""
    w = f"({z} + 8)"
    series = f"1 / (12D * {w}) - 1 / (360D * pow({w}, 3)) + 1 / (1260D * pow({w}, 5)) - 1 / (1680D * pow({w}, 7)) + 1 / (1188D * pow({w}, 9))"
    steps = " * ".join(f"({z} + {i})" for i in range(8))
    return f"(({w} - 0.5D) * ln({w}) - {w} + 0.5D * ln(2 * pi()) + {series} - ln({steps}))"


def chi2_tail(x: str, df: str) -> Column:
    """Upper tail of chi-square with any number of degrees of freedom; null for null, one for ``x <= 0``.

    The regularised incomplete gamma function: below ``a + 1`` by its series, above by its continued fraction from the
    tail inwards.  Both need terms in proportion to the root of ``a``.
    """
    a, h = f"(({df}) / 2D)", f"(({x}) / 2D)"
    front = f"exp({a} * ln({h}) - {h} - {log_gamma(a)})"
    terms = f"sequence(1, CAST(80 + 12 * sqrt({a}) AS INT))"
    series = f"aggregate({terms}, struct(1D AS term, 1D AS total), (s, n) -> struct(s.term * {h} / ({a} + n) AS term, s.total + s.term * {h} / ({a} + n) AS total), s -> s.total) / {a}"
    fraction = f"aggregate(reverse({terms}), 0D, (t, n) -> n * (n - {a}) / ({h} + 2 * n + 1 - {a} - t), t -> 1 / ({h} + 1 - {a} - t))"
    return F.expr(f"CASE WHEN ({x}) IS NULL OR ({df}) IS NULL OR ({df}) <= 0 THEN NULL WHEN ({x}) <= 0 THEN 1D WHEN {h} < {a} + 1 THEN greatest(0D, 1 - {front} * {series}) ELSE least(1D, {front} * {fraction}) END")
