"""From a vendor's table to the canonical column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel import finite


def adapt(data: DataFrame, *, date: str = "date", asset_id: str = "asset_id", price: str = "close", open: str | None = None, high: str | None = None, low: str | None = None, volume: str | None = None, fill_forward: bool = False) -> DataFrame:  # noqa: A002
    """Rename to date, asset_id, price, open, high, low, volume; dates become timestamps.

    With ``fill_forward``, numbers that aren't finite become null and take the last
    number of their asset.
    """
    if not isinstance(data, DataFrame):
        raise TypeError(f"expected a Spark DataFrame, got {type(data).__name__}; use spark.createDataFrame")
    names = {}
    for canonical, source in (("date", date), ("asset_id", asset_id), ("price", price), ("open", open), ("high", high), ("low", low), ("volume", volume)):
        if source is None or source == canonical:
            continue
        if source not in data.columns:
            raise ValueError(f"adapt: column {source!r} not found; available: {data.columns}")
        if canonical in data.columns:
            raise ValueError(f"adapt: can't rename {source!r} to {canonical!r}, which exists; drop or rename it first")
        names[source] = canonical
    out = data.withColumnsRenamed(names)
    if "date" in out.columns and isinstance(out.schema["date"].dataType, T.DateType):
        out = out.withColumn("date", F.col("date").cast("timestamp"))
    if fill_forward:
        until = Window.partitionBy("asset_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        for f in out.schema.fields:
            if isinstance(f.dataType, T.NumericType) and f.name not in ("asset_id", "date"):
                clean = F.when(finite(F.col(f.name)), F.col(f.name)) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f.name)
                out = out.withColumn(f.name, F.last(clean, ignorenulls=True).over(until))
    return out
