"""Tables of vectors: which rows take part, their fixed-point form, their common length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the fixed-point form in a unit.
SCALE = 256


def finite(vector: str) -> Column:
    """Whether the vector is there, has a component, and all of its components are finite numbers (null counts as no)."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.abs(x) < float("inf")), F.lit(False))


def fixed_point(vector: str) -> Column:
    """array<long>: each component times 256, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that all vectors share, 0 for an empty table; vectors of several lengths are an error."""
    least, most = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components; all must have one length")
    return least or 0
