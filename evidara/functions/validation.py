"""Bringing rows under a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order and types: absent ones are null, others go, NaN is null, lists may be null."""
    types = dict(rows.dtypes)
    out = []
    for f in StructType.fromDDL(schema).fields:
        c = F.col(f"`{f.name}`") if f.name in types else F.lit(None)
        if types.get(f.name) in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)
