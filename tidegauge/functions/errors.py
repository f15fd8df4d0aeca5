"""Error measures as column expressions (ANSI-safe: no division by zero)."""

from pyspark.sql import Column, functions as F


def percentage_error(approx: Column, real: Column) -> Column:
    """0 when equal, else |(real - approx) / real| * 100; infinite when only `real` is 0."""
    a, r = approx.cast("double"), real.cast("double")
    return (F.when(a == r, F.lit(0.0))
            .when(r == 0, F.lit(float("inf")))
            .otherwise(F.abs((r - a) / r) * 100.0))


def relative_error(approx: Column, real: Column) -> Column:
    """|(real - approx) / real|, NULL for 0/0 and infinite for x/0."""
    a, r = approx.cast("double"), real.cast("double")
    return (F.when((r == 0) & (a == 0), F.lit(None).cast("double"))
            .when(r == 0, F.lit(float("inf")))
            .otherwise(F.abs((r - a) / r)))


def query_error(real: Column, approx: Column) -> Column:
    """Relative error of a query answer: 0 when equal, NULL when undefined."""
    undefined = real.isNull() | approx.isNull() | F.isnan(real) | F.isnan(approx)
    return (F.when(undefined, F.lit(None).cast("double"))
            .when(real == approx, F.lit(0.0))
            .when(real == 0, F.lit(None).cast("double"))
            .otherwise(F.abs((real - approx) / real)))
