"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor before a component is rounded down.
SCALE = 1024


def usable(vector: Column, most: float) -> Column:
    """True when every entry is there, finite and of a size of at most ``most``."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)), F.lit(False))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, most: float) -> DataFrame:
    """(vec_id, vector array<double>) of the rows whose vector can be used."""
    return df.filter(usable(F.col(vector_col), most)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def whole_numbers(column: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(1024 * x) of a list column whose lists have ``size`` entries."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(-1, size) * SCALE).astype(np.int64)
