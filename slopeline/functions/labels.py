"""Label projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarize(label: str | Column, positive: float = 1.0) -> Column:
    """One-vs-rest label: the ``positive`` value stays 1.0, every other label becomes 0.0.
    A null label stays null so that validation can reject it."""
    c = (F.col(label) if isinstance(label, str) else label).cast("double")
    return F.when(c == F.lit(float(positive)), F.lit(1.0)).when(c.isNotNull(), F.lit(0.0))
