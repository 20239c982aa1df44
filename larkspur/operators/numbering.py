"""Dense positions over a unique integer order column, without an unbounded single-task window.

Rows are cut into blocks of 2**bits consecutive order values. As the values are unique a block holds at
most 2**bits rows, however the rows are spread, so the per-block window is bounded. The start of a block
is the number of rows in earlier blocks. It is summed level by level: over the blocks of one block of
blocks, then over those, and so on. Every window on the way is bounded by 2**bits rows, and with the
default the last one by 2**22 rows for any 64-bit value. All of it depends on row values only, so a lost
executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import stored

BITS = 14
LEVELS = 3


def _starts(counts: DataFrame, bits: int, levels: int) -> DataFrame:
    """Running start (_at_block, _rows, _start) of blocks given as (_at_block, _rows)."""
    before = Window.orderBy("_at_block").rowsBetween(Window.unboundedPreceding, -1)
    if levels == 1:
        return counts.select("_at_block", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    above = counts.withColumn("_above", F.shiftright("_at_block", bits))
    inside = Window.partitionBy("_above").orderBy("_at_block").rowsBetween(Window.unboundedPreceding, -1)
    upper = _starts(above.groupBy(F.col("_above").alias("_at_block")).agg(F.sum("_rows").alias("_rows")), bits, levels - 1)
    return (
        above.select("_at_block", "_rows", "_above", F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_inside"))
        .join(upper.select(F.col("_at_block").alias("_above"), F.col("_start").alias("_above_start")), "_above")
        .select("_at_block", "_rows", (F.col("_above_start") + F.col("_inside")).alias("_start"))
    )


def _numbered(rows: DataFrame, order_col: str, starts: DataFrame, name: str, bits: int) -> DataFrame:
    """Rows of the blocks in ``starts`` with their position."""
    in_block = Window.partitionBy("_at_block").orderBy(order_col)
    return (
        rows.withColumn("_at_block", _block(order_col, bits))
        .withColumn("_at", F.row_number().over(in_block).cast("long") - 1)
        .join(starts, "_at_block")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_at_block", "_at", "_start", "_rows")
    )


def _block(order_col: str, bits: int) -> Column:
    return F.shiftright(F.col(order_col).cast("long"), bits)


def _counts(rows: DataFrame, order_col: str, bits: int) -> DataFrame:
    return rows.groupBy(_block(order_col, bits).alias("_at_block")).agg(F.count("*").alias("_rows"))


def positions(df: DataFrame, order_col: str, name: str = "position", bits: int = BITS) -> DataFrame:
    """(order_col, position) of each row. The order column is stored once, so that ``df`` runs once."""
    order = stored(df.select(order_col), "order")
    return _numbered(order, order_col, _starts(_counts(order, order_col, bits), bits, LEVELS), name, bits)


def with_position(df: DataFrame, order_col: str, name: str = "position", bits: int = BITS) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_col`` (unique integers).

    ``df`` runs twice: once for its order column alone, and once in the plan that is returned.
    """
    return df.join(positions(df, order_col, name, bits), order_col).select(*df.columns, name)


def dealt_positions(df: DataFrame, order_col: str, size: int, name: str = "position", bits: int = BITS) -> DataFrame:
    """``with_position`` for wide rows that are to lie together by runs of ``size`` positions: one shuffle of the wide rows.

    Rows are dealt by the run in which their block starts, so that the rows of a run are in two tasks at most, and
    numbered there, block by block. ``df`` runs twice: once for the counts of its blocks, and once in the plan that is returned. The starts
    are stored, one row per block, so that Spark knows their size and need not shuffle the wide rows to meet them.
    """
    counts = stored(_counts(df, order_col, bits), "counts")
    starts = stored(_starts(counts, bits, LEVELS).select("_at_block", "_start"), "starts")
    dealt = (
        df.withColumn("_at_block", _block(order_col, bits))
        .join(starts, "_at_block")
        .withColumn("_run", F.floor(F.col("_start") / size))
        .repartition("_run")
    )
    in_block = Window.partitionBy("_run", "_at_block").orderBy(order_col)
    # As in with_position, rows of one order value are at each of their places; unique ones have one.
    low = F.col("_start") + F.rank().over(in_block) - 1
    alike = F.count(F.lit(1)).over(in_block.rangeBetween(Window.currentRow, Window.currentRow))
    placed = dealt.withColumn("_low", low).withColumn("_high", F.col("_low") + alike - 1)
    return placed.select(*df.columns, F.explode(F.sequence("_low", "_high")).alias(name))


def window_at(df: DataFrame, order_col: str, start: int, size: int, bits: int = BITS) -> DataFrame:
    """Rows ``start`` to ``start + size`` in the order of ``order_col`` (unique integers), sorted.

    Blocks are counted from the order column alone, and the few that reach into the window are stored. They follow one another, so the
    rows to number lie in one range of the order column, which reaches the scan: its plan is the same, and its shuffle as
    small, at any depth.
    """
    starts = _starts(_counts(df, order_col, bits), bits, LEVELS)
    reach = (F.col("_start") < start + size) & (F.col("_start") + F.col("_rows") > start)
    blocks = stored(starts.where(reach).select("_at_block", "_start"), "blocks")
    low, high = blocks.agg(F.min("_at_block"), F.max("_at_block")).first()
    if low is None:
        return df.limit(0)
    inside = df.where(F.col(order_col).between(low << bits, ((high + 1) << bits) - 1))
    numbered = _numbered(inside, order_col, blocks, "_position", bits)
    return numbered.where(F.col("_position").between(start, start + size - 1)).orderBy(order_col).select(*df.columns)
