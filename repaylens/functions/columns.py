"""Small column expressions shared by all analyses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repaylens.schemas import BAND_ORDER


def quoted(text: str) -> str:
    """A string literal for SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def either_label(condition: Column, yes: str, no: str) -> Column:
    """One of two labels; a null condition takes the second."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; null where the denominator is zero.

    Here and below, text is an SQL expression over the columns at hand.
    """
    if isinstance(numerator, str) and isinstance(denominator, str):
        return F.expr(_ratio_sql(numerator, denominator))
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator`` per hundred of ``denominator``, unrounded."""
    if isinstance(numerator, str) and isinstance(denominator, str):
        return F.expr(_percent_sql(numerator, denominator))
    return F.try_divide(_col(numerator).cast("double") * 100.0, _col(denominator).cast("double"))


def pct(numerator: str, denominator: str, digits: int = 2) -> Column:
    """Rounded percentage; null where the denominator is zero."""
    return F.expr(f"round({_percent_sql(numerator, denominator)}, {digits})")


def rounded_ratio(numerator: str, denominator: str, digits: int = 2) -> Column:
    return F.expr(f"round({_ratio_sql(numerator, denominator)}, {digits})")


def rounded(column: str, digits: int = 2) -> Column:
    return F.expr(f"round({column}, {digits})")


def _ratio_sql(numerator: str, denominator: str) -> str:
    return f"try_divide(cast({numerator} AS double), cast({denominator} AS double))"


def _percent_sql(numerator: str, denominator: str) -> str:
    return f"try_divide(cast({numerator} AS double) * 100D, cast({denominator} AS double))"


def month_of(col: Column | str) -> Column:
    return F.trunc(_col(col), "MM")


def rank_of(column: str, order: Sequence[str]) -> Column:
    """Position of a label in its business order; unknown labels and null come last."""
    ranks = " ".join(f"WHEN {quoted(label)} THEN {i}" for i, label in enumerate(order, start=1))
    return F.expr(f"CASE {column} {ranks} ELSE {len(order) + 1} END")


def sort_keys(keys: Iterable[str]) -> list[Column]:
    """Ordering for segment keys: bands by business order, everything else by value."""
    out: list[Column] = []
    for key in keys:
        if key in BAND_ORDER:
            out.append(rank_of(key, BAND_ORDER[key]).asc())
        out.append(F.col(key).asc_nulls_first())
    return out


def mapped(col: Column | str, labels: Mapping[str, str]) -> Column:
    """Look a value up in a fixed dictionary; null where it has no entry."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), _col(col))


def to_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Read text or timestamp columns as dates."""
    return df.withColumns({name: F.to_date(name) for name in columns})


def money_as_double(df: DataFrame) -> DataFrame:
    """Result tables carry plain doubles; decimals are only needed while summing."""
    money_columns = [name for name, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({name: F.col(name).cast("double") for name in money_columns})


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
