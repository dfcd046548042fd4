"""Ordered scans: what comes before or after a row of its key, whatever share of all rows a key has.

A window function puts all rows of a key in one task.  Where a key has more than ``limit`` rows,
rows go instead by ranges of (key, order), so that a large key is cut into blocks.  Each block
is scanned for itself, and what it needs from the blocks of its key before it is carried over
from their summaries, a row a block: a second scan over very few rows.  Results are the same
either way.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.storage import through_files

#: Rows of a key that one task may take.
LIMIT = 1_000_000


class Scan(NamedTuple):
    """A column to add.

    before / after: ``value`` of the row before or after; last: the newest non-null ``value`` up
    to and with this row; reached: the largest ``value`` of the rows before; place: the number
    of the row, from 1.
    """

    kind: str
    name: str
    value: str | None = None


_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _inside(s: Scan, over) -> Column:
    if s.kind == "place":
        return F.row_number().over(over)
    value = F.col(s.value)
    if s.kind == "last":
        return F.last(value, ignorenulls=True).over(over.rowsBetween(*_SO_FAR))
    if s.kind == "reached":
        return F.max(value).over(over.rowsBetween(*_BEFORE))
    box = F.struct(value.alias("v"))  # a null value is told apart from no row
    return (F.lag(box) if s.kind == "before" else F.lead(box)).over(over)


def _summary(s: Scan) -> Column:
    if s.kind == "place":
        return F.count("*")
    value = F.col(s.value)
    if s.kind == "reached":
        return F.max(value)
    if s.kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col("_n")))
    box = F.struct(value.alias("v"))
    return F.max_by(box, "_n") if s.kind == "before" else F.min_by(box, "_n")


def _carried(s: Scan, keys: list[str]) -> Column:
    blocks = Window.partitionBy(*keys).orderBy("_p")
    if s.kind == "after":
        return F.first(s.name, ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing))
    over = blocks.rowsBetween(*_BEFORE)
    if s.kind == "place":
        return F.sum(s.name).over(over)
    return (F.max(s.name) if s.kind == "reached" else F.last(s.name, ignorenulls=True)).over(over)


def _both(s: Scan, here: Column, carried: Column) -> Column:
    if s.kind == "place":
        return (here + F.coalesce(carried, F.lit(0))).cast("int")
    if s.kind == "reached":
        return F.greatest(here, carried)
    return F.coalesce(here, carried)


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest key, and of all."""
    return tuple(df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first())


def _placed(df: DataFrame, keys: list[str], order: list[Column], n: int, names: list[str]) -> DataFrame:
    """Places by ranges with one shuffle: rows are numbered as they lie in their sorted block, and a block's numbers are moved to where its key stands."""
    blocks = through_files(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    blocks = blocks.withColumn("_p", F.shiftright("_id", 33))  # the number of the task, as that function documents
    ends = blocks.groupBy("_p", *keys).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(*_BEFORE)), F.lit(0))
    # written, so that its size is known and rows are not shuffled again for a table of a row a block and key
    ends = through_files(ends.select("_p", *keys, (before - F.col("_first") + 1).alias("_shift")))
    same = F.col("r._p") == F.col("c._p")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    got = blocks.alias("r").join(ends.alias("c"), same).select("r.*", "c._shift")
    return got.select(*df.columns, *[(F.col("_id") + F.col("_shift")).cast("int").alias(n) for n in names])


def scanned(df: DataFrame, keys: list[str], order: list[Column], scans: list[Scan], limit: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with a column for each scan; ``order`` (of sort expressions) is total within a key but for equal rows.

    ``sizes`` are ``key_sizes`` of ``df`` or of more rows, where they are known already.
    """
    limit = LIMIT if limit is None else limit
    most, total = sizes or key_sizes(df, keys)
    unboxed = lambda s: F.col(s.name)["v"] if s.kind in ("before", "after") else F.col(s.name)
    if most <= limit:
        over = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({s.name: _inside(s, over) for s in scans}).withColumns({s.name: unboxed(s) for s in scans})
    n = max(3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / max(1, limit)))
    if all(s.kind == "place" for s in scans):
        return _placed(df, keys, order, n, [s.name for s in scans])
    blocks = through_files(df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()))
    over = Window.partitionBy("_p", *keys).orderBy(*order)
    rows = blocks.withColumns({"_n": F.row_number().over(over)} | {s.name: _inside(s, over) for s in scans})
    ends = rows.groupBy("_p", *keys).agg(*[_summary(s).alias(s.name) for s in scans])
    carried = ends.select("_p", *keys, *[_carried(s, keys).alias(f"_c_{s.name}") for s in scans]).alias("c")
    same = F.col("r._p") == F.col("c._p")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    got = rows.alias("r").join(carried, same, "left").select("r.*", *[f"c._c_{s.name}" for s in scans])
    got = got.withColumns({s.name: _both(s, F.col(s.name), F.col(f"_c_{s.name}")) for s in scans})
    return got.withColumns({s.name: unboxed(s) for s in scans}).select(*df.columns, *[s.name for s in scans])


def asof(left: DataFrame, right: DataFrame, key: str, at: str, since: str, end: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Each row of ``left`` whose moment ``at`` lies in a window [since, end) of its key, with that window's ``columns``.

    Windows of a key do not overlap; a null end is open.  Both sides are put in one order and
    each row of ``left`` takes the last window that began before it or with it: there is no join
    on a range.
    """
    kept = F.struct(F.col(end).alias("_end"), *columns)
    windows = right.filter(F.col(since).isNotNull()).select(
        F.col(key), F.col(since).alias("_t"), F.lit(0).alias("_kind"), F.col(end).isNull().alias("_open"), F.col(end).alias("_until"), kept.alias("_w"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    rows = left.filter(F.col(at).isNotNull()).select(
        F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(False).alias("_open"), F.lit(None).cast(right.schema[end].dataType).alias("_until"),
        F.lit(None).cast(windows.schema["_w"].dataType).alias("_w"), F.struct(*left.columns).alias("_l"))
    both = scanned(windows.unionByName(rows), [key], [F.col("_t"), F.col("_kind"), F.col("_open"), F.col("_until")], [Scan("last", "_held", "_w")], limit)
    inside = (F.col("_kind") == 1) & F.col("_held").isNotNull() & (F.col("_held._end").isNull() | (F.col("_t") < F.col("_held._end")))
    return both.filter(inside).select("_l.*", *[F.col(f"_held.{c}").alias(c) for c in columns])
