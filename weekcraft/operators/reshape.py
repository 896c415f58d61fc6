"""Reshape operators: unpivot, pivot, conform (RSH-1, RSH-3, SCH-7, SCH-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def unpivot_measures(df: DataFrame, ids: list[str], measures: list[tuple[str, str]],
                     keep_null: tuple[str, ...] = (), concept_col: str = "concept",
                     value_col: str = "total") -> DataFrame:
    """Wide measures -> (concept label, value) rows (RSH-1).

    One ``Expand`` over one scan instead of one scan per measure. Null values are dropped,
    except for the labels listed in ``keep_null``.
    """
    labelled = df.select(*ids, *[F.col(m).cast("double").alias(label) for m, label in measures])
    long = labelled.unpivot(ids, [label for _, label in measures], concept_col, value_col)
    keep = F.col(value_col).isNotNull()
    if keep_null:
        keep = keep | F.col(concept_col).isin(*keep_null)
    return long.filter(keep)


def pivot_days(long: DataFrame, keys: list[str], day_col: str, value_col: str, days: list,
               order_col: str | None = None) -> DataFrame:
    """(keys, day, value) -> one column per day with the first non-null value (RSH-3).

    The day list is passed explicitly, so Spark skips the distinct-values job; a null key
    row is removed first (the reference drops rows whose group key is null). "First" is
    made deterministic with ``min_by(value, order_col)`` over non-null values.
    """
    base = long.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    base = base.filter(F.col(value_col).isNotNull())
    if order_col:
        agg = F.min_by(F.col(value_col), F.col(order_col))
    else:
        agg = F.first(F.col(value_col), ignorenulls=True)
    return base.groupBy(*keys).pivot(day_col, days).agg(agg)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select in the schema's order; missing columns become typed nulls; widen types (SCH-7/SCH-9).

    Narrowing casts are refused.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name in present:
            src = present[f.name]
            if _narrows(src, f.dataType):
                raise ValueError(f"narrowing {f.name}: {src.simpleString()} -> {f.dataType.simpleString()}")
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _narrows(src: T.DataType, dst: T.DataType) -> bool:
    if isinstance(src, T.DecimalType) and isinstance(dst, T.DecimalType):
        return dst.precision - dst.scale < src.precision - src.scale or dst.scale < src.scale
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    si = next((i for i, t in enumerate(order) if isinstance(src, t)), None)
    di = next((i for i, t in enumerate(order) if isinstance(dst, t)), None)
    if si is not None and di is not None:
        return di < si
    return False
