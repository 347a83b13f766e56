"""Places and running sums in the order of a whole table, or of its groups, with no table and no group in one task.

The table is range-partitioned on the sort key, sorted inside each partition and written with each row's place there.
Partitions then give their totals, one row for each partition and group; the totals before a partition are its offset,
which is added to what a row has reached inside its own. A group that holds a third of all rows is spread like the
others; rows of equal keys may fall in several partitions.

Tables should be scans or written ones, so that a repeated task sees its rows in the same order. Groups and sort keys may
be null; ties are broken by the rows' first places.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from geoquarry.sources.scratch import scratch

_PART, _ROW = "__part", "__row"
#: Low bits of a row's number: its place in the task.
_PLACE = (1 << 33) - 1


def dealt(df: DataFrame, order: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """The rows with ``__part`` and ``__row``: ascending (part, row) is the order by ``within``, then ``order``."""
    keys = [*(F.col(c).asc_nulls_first() for c in within), *order, F.col(_ROW).asc()]
    sorted_rows = df.withColumn(_ROW, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_ROW)
    path = scratch(df.sparkSession, "dealt")
    out = sorted_rows.withColumns({_PART: F.spark_partition_id(), _ROW: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _before(totals: DataFrame, within: Sequence[str], amount: str) -> DataFrame:
    """``totals`` (one row for each partition and group) with ``__before``: the sum of ``amount`` over earlier partitions."""
    if within:
        window = Window.partitionBy(*within).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn("__before", F.coalesce(F.sum(amount).over(window), F.lit(0).cast(totals.schema[amount].dataType)))
    # one row for each partition: the driver adds them up
    rows = sorted(totals.collect(), key=lambda r: r[_PART])
    zero = type(rows[0][amount])(0) if rows else 0
    sums = accumulate((r[amount] for r in rows), initial=zero)
    schema = StructType([*totals.schema.fields, StructField("__before", totals.schema[amount].dataType)])
    return totals.sparkSession.createDataFrame([(*r, s) for r, s in zip(rows, sums, strict=False)], schema)


def _met(rows: DataFrame, totals: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows with the columns of their partition's and group's total."""
    renamed = totals.withColumnsRenamed({c: f"__of_{c}" for c in (_PART, *within)})
    same = F.col(_PART) == F.col(f"__of_{_PART}")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(renamed, same)


def ranked(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """``df`` with ``name``: the row's place, from 0, in the order of its group."""
    rows = dealt(df, order, within)
    totals = _before(rows.groupBy(_PART, *within).agg(F.count("*").alias("__n"), F.min(_ROW).alias("__first")), within, "__n")
    return _met(rows, totals, within).select(*df.columns, (F.col("__before") + F.col(_ROW) - F.col("__first")).alias(name))


def running_sum(df: DataFrame, value: str, order: Sequence[Column], within: Sequence[str] = (), name: str = "reached") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the row and all rows before it in its group; nulls add nothing."""
    added = df.withColumn("__v", F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType)))
    rows = dealt(added, order, within)
    local = Window.partitionBy(_PART, *within).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    totals = _before(rows.groupBy(_PART, *within).agg(F.sum("__v").alias("__n")), within, "__n")
    return _met(rows.withColumn("__own", F.sum("__v").over(local)), totals, within).select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))


def last_before(df: DataFrame, value: str, order: Sequence[Column], name: str = "last") -> DataFrame:
    """``df`` with ``name``: the last ``value`` that is not null among the row and all rows before it, null where there is none."""
    rows = dealt(df, order)
    local = Window.partitionBy(_PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.groupBy(_PART).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(_ROW))).alias("__last"))
    # one row for each partition: the driver carries the values over
    held, carried = None, []
    for r in sorted(own.collect(), key=lambda r: r[_PART]):
        carried.append((r[_PART], held))
        held = r["__last"] if r["__last"] is not None else held
    schema = StructType([own.schema[_PART], StructField("__before", own.schema["__last"].dataType)])
    totals = df.sparkSession.createDataFrame(carried, schema)
    found = rows.withColumn("__own", F.last(value, ignorenulls=True).over(local))
    return _met(found, totals, ()).select(*df.columns, F.coalesce("__own", "__before").alias(name))


#: Rows up to which a page is taken by Spark's own top-k, which gathers all rows before its end in one task.
NEAR_ROWS = 10_000


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int, near: int = NEAR_ROWS) -> DataFrame:
    """``limit`` rows from ``offset`` on, in order. Beyond ``near`` rows only the partitions that hold the page are read again.

    The table is dealt by ranges of the sort key; the numbers of rows of its partitions tell which of them the page lies in.
    Rows with equal keys come in any order, so ``order`` should end with a key of its own for each row.
    """
    if offset + limit <= near:
        return df.orderBy(*order).offset(offset).limit(limit)
    rows = dealt(df, order)
    begin, held = 0, []
    for r in sorted(rows.groupBy(_PART).agg(F.count("*").alias("n")).collect(), key=lambda r: r[_PART]):
        if begin < offset + limit and begin + r["n"] > offset:
            held.append((r[_PART], max(0, offset - begin), min(r["n"], offset + limit - begin)))
        begin += r["n"]
    inside = F.lit(False)
    for part, first, end in held:
        inside = inside | ((F.col(_PART) == part) & (F.col(_ROW) >= first) & (F.col(_ROW) < end))
    # the page itself: at most ``limit`` rows
    return rows.where(inside).orderBy(_PART, _ROW).drop(_PART, _ROW)
