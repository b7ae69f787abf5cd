"""Name similarity that no built-in function has, on blocked candidate pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, 0 for a null."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")
