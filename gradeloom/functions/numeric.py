"""Rounded means, spreads and correlations that do not lose digits on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A one-decimal judge score as a whole number of tenths, in SQL.
TENTHS = "cast(judge_score * 10 as bigint)"


def mean_of_sums(total: str, n: str, scale: int, unit: int = 1) -> Column:
    """``total / (n * unit)`` rounded once, half away from zero; NULL when n is 0.

    Both are SQL expressions over whole numbers. The quotient of two whole
    decimals keeps 18 digits after the point, so the rounding sees the exact tie
    cases that a double or a ``decimal(7,5)`` mean would already have lost.
    """
    count = f"cast(nullif(({n}) * {unit}, 0) as decimal(20,0))"
    return F.expr(f"cast(round(cast({total} as decimal(20,0)) / {count}, {scale}) as double)")


def mean_cost(total: str, n: str, scale: int = 6) -> Column:
    """Mean of a summed decimal cost, rounded once."""
    count = f"cast(nullif({n}, 0) as decimal(20,0))"
    return F.expr(f"cast(round(cast({total} as decimal(24,9)) / {count}, {scale}) as double)")


def stddev_of_sums(n: str, total: str, total_sq: str, unit: int = 1) -> Column:
    """Sample standard deviation from additive sums; NULL below two values."""
    square = f"cast({total} as decimal(19,0)) * cast({total} as decimal(19,0))"
    spread = f"cast({n} as decimal(18,0)) * cast({total_sq} as decimal(20,0)) - {square}"
    return F.expr(f"CASE WHEN {n} > 1 THEN sqrt(cast({spread} as double) / (cast({n} as double) * cast({n} - 1 as double))) / {unit} END")


def guarded_corr(y: Column, x: Column) -> Column:
    """Pearson correlation; NULL on constant or missing input instead of an error."""
    both = y.isNotNull() & x.isNotNull()
    y, x = (F.when(both, c.cast("double")) for c in (y, x))
    return F.try_divide(F.covar_samp(y, x), F.stddev_samp(y) * F.stddev_samp(x))


def moments(y: str, x: str, name: str) -> list[Column]:
    """Whole-number sums of pairs without a NULL, which add up over any partitioning.

    ``y`` and ``x`` are SQL expressions of whole numbers; ``name`` begins the columns.
    """
    both = f"({y}) IS NOT NULL AND ({x}) IS NOT NULL"
    of = lambda e, kind: f"sum(CASE WHEN {both} THEN cast({e} as {kind}) ELSE 0 END)"
    long = lambda e: f"cast({e} as bigint)"
    sums = {"n": f"count_if({both})", "x": of(x, "bigint"), "y": of(y, "bigint")}
    sums |= {"xx": of(f"{long(x)} * {long(x)}", "decimal(20,0)")}
    # Scores are small: these sums fit a long, and one that does not is an error.
    sums |= {k: of(f"{long(a)} * {long(y)}", "bigint") for k, a in (("xy", x), ("yy", y))}
    return [F.expr(f"{e} AS {name}_{k}") for k, e in sums.items()]


MOMENTS = ("n", "x", "y", "xx", "xy", "yy")


def _deviations(name: str, a: str, b: str) -> Column:
    """n * sum(ab) - sum(a) * sum(b), exact until it becomes a double."""
    first = lambda c: f"cast({name}_{c} as decimal(18,0))"
    whole = f"cast({name}_n as decimal(13,0)) * cast({name}_{a}{b} as decimal(24,0)) - {first(a)} * {first(b)}"
    return F.expr(f"cast({whole} as double)")


def corr_of_moments(name: str) -> Column:
    """Pearson correlation from ``moments``; NULL on constant or missing input."""
    return F.try_divide(_deviations(name, "x", "y"), F.sqrt(_deviations(name, "x", "x")) * F.sqrt(_deviations(name, "y", "y")))


def slope_of_moments(name: str) -> Column:
    """Slope of y over x from ``moments``; NULL on constant or missing input."""
    return F.try_divide(_deviations(name, "x", "y"), _deviations(name, "x", "x"))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two zone-less timestamps; NULL while unfinished.

    Read off the interval's own fields: no session time zone is involved.
    """
    span = end - start
    field = lambda name: F.extract(F.lit(name), span).cast("double")
    minutes = (field("DAY") * 24 + field("HOUR")) * 60 + field("MINUTE")
    return minutes * 60000 + field("SECOND") * 1000


def scale_verdict(score_text: Column) -> Column:
    """0..1 score text onto 0..5 in steps of 0.1, ties to the even tenth."""
    return F.bround(score_text.cast("decimal(20,15)") * 5, 1).cast("decimal(3,1)")
