import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import errors, models

# approximation, real, expected percentage error
CASES = [(0, 0, 0), (37, 37, 0), (1, 0, math.inf), (-1, 0, math.inf), (0, 1, 100), (0, -1, 100), (2, 4, 50),
         (-102, -100, 2), (4, 2, 100), (-1, 1, 200), (1, -1, 200)]


@pytest.mark.parametrize("approx, real, expected", CASES)
def test_percentage_error_of_arrays(approx, real, expected):
    assert models.percentage_error(np.float32(approx), np.float32(real)) == pytest.approx(expected)


def test_percentage_error_column(spark):
    d = spark.createDataFrame([(float(a), float(r), float(e)) for a, r, e in CASES], "a double, r double, e double")
    got = d.select(errors.percentage_error(F.col("a"), F.col("r")).alias("x"), "e").collect()
    assert all(row.x == pytest.approx(row.e) for row in got)


def test_query_error_is_null_when_undefined(spark):
    rows = [(5.0, 5.0), (0.0, 0.0), (0.0, 1.0), (None, 1.0), (4.0, 5.0), (float("nan"), 1.0)]
    d = spark.createDataFrame(rows, "r double, a double")
    got = [r.x for r in d.select(errors.query_error(F.col("r"), F.col("a")).alias("x")).collect()]
    assert got == [0.0, 0.0, None, None, 0.25, None]
