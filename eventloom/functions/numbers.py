"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAX_DECIMALS = 30
SMALL_EXPONENT = -20  # from here on digits are shifted as text
NUMERIC_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def as_double(df: DataFrame, name: str) -> Column:
    """The column as a double; a float is widened through text so that 37.6 stays 37.6. Text that is no number is null."""
    kind = df.schema[name].dataType
    col = F.col(name)
    return col if isinstance(kind, DoubleType) else col.cast("string").try_cast("double")


def significant_text(value: Column, sig_figs: int = 3) -> Column:
    """Plain decimal text of a double, rounded to `sig_figs` figures.

    Whole numbers are printed unrounded. Other values are scaled so that the wanted figures are the integer part, rounded
    half away from zero and scaled back; `%f` prints the shortest digits of a double, so neither binary residue nor
    exponent notation appears once trailing zeros are cut.
    """
    figures_before_point = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.lit(sig_figs - 1) - figures_before_point)
    rounded = F.round(value * scale, 0) / scale
    decimal_text = F.regexp_replace(F.format_string(f"%.{MAX_DECIMALS}f", rounded), r"\.?0+$", "")
    decimal_text = F.when(figures_before_point < SMALL_EXPONENT, _small_text(value, sig_figs)).otherwise(decimal_text)
    wide = F.coalesce(value.try_cast("decimal(38,0)").cast("string"), value.cast("string"))
    integer = F.coalesce(value.try_cast("long").cast("string"), wide)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value) | (F.abs(value) == float("inf")), value.cast("string"))
        .when(value % 1 == 0, integer)
        .otherwise(decimal_text)
    )


def _small_text(value: Column, sig_figs: int) -> Column:
    """Decimal text of a number close to zero: the wanted figures as an integer, behind as many zeros as the exponent says.

    The number is first brought near one by a power of ten in two halves, as the whole power may exceed a double.
    """
    exponent = F.floor(F.log10(F.abs(value))).cast("int")
    half = F.floor((F.lit(sig_figs - 1) - exponent) / 2).cast("int")
    shifted = F.abs(value) * F.pow(F.lit(10.0), half) * F.pow(F.lit(10.0), F.lit(sig_figs - 1) - exponent - half)
    figures = F.round(shifted, 0).cast("long").cast("string")
    zeros = F.repeat(F.lit("0"), F.lit(sig_figs - 1) - exponent - F.length(figures))
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0."), zeros, F.regexp_replace(figures, "0+$", ""))


def lenient_float(col: Column) -> Column:
    """Text to float; anything that is not a plain number becomes null."""
    return F.when(col.rlike(NUMERIC_TEXT), col.try_cast("float"))


def clamp(col: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def fahrenheit_to_celsius(col: Column, threshold: float = 45) -> Column:
    """Readings above the threshold are taken as Fahrenheit."""
    return F.when(col > threshold, (col - 32) * 5 / 9).otherwise(col)
