"""Decimal rounding as tick data needs it: one digit at a time, half up at each step, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES, SIGNIFICANT = 14, 7


def cascade(value: Column, digits: Column | int) -> Column:
    """A non-negative integer without its last ``digits`` digits, dropped one at a time, each rounding half up.

    A run of digits carries up from 44...45 on, so one addition of 55...55 before the division has the same effect.
    """
    power = F.pow(F.lit(10.0), digits if isinstance(digits, Column) else F.lit(digits)).cast("long")
    return F.call_function("div", value + F.call_function("div", 5 * (power - 1), F.lit(9)), power)


def quotient(over: Column, under: Column) -> Column:
    """|over / under| in units of 10**-PLACES, rounded half up; null if ``under`` is 0. The argument of ``ratio``."""
    a, b = F.abs(over).cast("decimal(20,0)"), F.nullif(F.abs(under), F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", a * F.lit(2 * 10**PLACES).cast("decimal(16,0)") + b, 2 * b).cast("long")


def ratio(exact: Column, sign: Column, scale: int = 5) -> Column:
    """A ``quotient`` in units of 10**-scale, under the sign of ``sign``: reduced to 7 digits, then cascaded.

    Give the quotient as a column of its own, as it is used several times.
    """
    drop = F.greatest(F.length(exact.cast("string")) - SIGNIFICANT, F.lit(0))
    power = F.pow(F.lit(10.0), drop).cast("long")
    seven = F.call_function("div", exact + F.call_function("div", power, F.lit(2)), power)
    return F.signum(sign.cast("double")).cast("long") * cascade(seven, F.greatest(PLACES - scale - drop, F.lit(0)))


def places_of(quotes: DataFrame, other: int) -> int:
    """The decimal places of the prices; ``other`` if they aren't decimals."""
    return getattr(quotes.schema["bid"].dataType, "scale", other)


def scaled(units: Column, places: int) -> Column:
    """Whole units of the last of ``places`` decimal places as a decimal."""
    return (units.cast("decimal(20,0)") * F.lit(f"1e-{places}").cast(f"decimal({places + 1},{places})")).cast(f"decimal(28,{places})")
