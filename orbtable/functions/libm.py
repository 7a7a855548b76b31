"""Functions of the C library, for results that hang on the last bit of a double.

The JVM's sines differ in the last bit from the C library's (and so from those of most databases) for two angles in a
thousand. Faces that are equally far out but for rounding are then ordered differently.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(function, values: pd.Series) -> np.ndarray:
    """function(value) of every distinct value; NaN where it is not finite."""
    few, at = np.unique(values.to_numpy(float, na_value=np.nan), return_inverse=True)
    return np.array([function(x) if math.isfinite(x) else math.nan for x in few.tolist()], float)[at]


def sin_cos(angle: Column) -> Column:
    """struct<sin, cos> of an angle."""
    @F.pandas_udf("struct<sin:double,cos:double>")
    def both(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"sin": _each(math.sin, a), "cos": _each(math.cos, a)})

    return both(angle)


def square(value: Column) -> Column:
    """pow(value, 2), which is not always value * value to the last bit."""
    @F.pandas_udf("double")
    def power(x: pd.Series) -> pd.Series:
        return pd.Series(_each(lambda v: math.pow(v, 2.0), x))

    return power(value)
