"""Numbers as Python's format() writes them: the binary value, rounded half to even."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _formatted(values: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else format(v, s) for v, s in zip(values, spec, strict=True)])


def py_format(value: Column, spec: str) -> Column:
    """format(value, spec), null for null. JVM formatters round half up, so this one function is Python; only rows that are reported come to it."""
    return _formatted(value.cast("double"), F.lit(spec))
