"""Two-sided p-values as plain Spark expressions.

Spark has no error function and no Student distribution. Both tails are computed
by Simpson's rule on a fixed grid. The expressions are meant for result rows, of
which an experiment has a handful, never for account rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTERVALS = 2000  # even number of Simpson intervals
_REACH = 12  # standard deviations after which the density is nil


def _integral(density: str, low: str, high: str) -> str:
    """SQL for the integral of ``density``, an expression in ``{x}``."""
    step = f"(({high}) - ({low})) / {_INTERVALS}D"
    height = density.format(x=f"({low} + {step} * i)")
    weight = f"CASE WHEN i IN (0, {_INTERVALS}) THEN 1D WHEN i % 2 = 1 THEN 4D ELSE 2D END"
    return (
        f"aggregate(sequence(0, {_INTERVALS}), 0D, (total, i) -> total + {weight} * {height})"
        f" * {step} / 3D"
    )


def normal_p_value(z: str) -> Column:
    """Two-sided tail of the standard normal distribution."""
    density = "2D / sqrt(2D * pi()) * exp(-{x} * {x} / 2D)"
    return F.expr(_integral(density, f"abs({z})", f"abs({z}) + {_REACH}D"))


def student_p_value(t: str, dof: str) -> Column:
    """Two-sided tail of Student's t with ``dof`` degrees of freedom.

    With ``t = sqrt(dof) * tan(a)`` the density is proportional to
    ``cos(a) ** (dof - 1)``, so the tail is a ratio of two integrals over angles.
    """
    angle, reach = f"atan(abs({t}) / sqrt({dof}))", f"{_REACH}D / sqrt({dof})"
    density = "power(greatest(cos({x}), 0D), " + f"{dof} - 1D)"
    tail = _integral(density, angle, f"least(pi() / 2D, {angle} + {reach})")
    whole = _integral(density, "0D", f"least(pi() / 2D, {reach})")
    return F.expr(f"least(({tail}) / ({whole}), 1D)")
