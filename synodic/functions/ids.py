"""Agent ids: type number in the upper eight bits, running number in the lower 36; 0 stands for no source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_SHIFT, NR_MASK = 56, (1 << 36) - 1


def make_id(type_id: int, nr: Column) -> Column:
    base = type_id << TYPE_SHIFT
    return F.lit(base - (1 << 64) if base >= 1 << 63 else base).bitwiseOR(nr.cast("long"))


def type_nr(ident: Column) -> Column:
    return F.shiftrightunsigned(ident, TYPE_SHIFT).cast("int")


def agent_nr(ident: Column) -> Column:
    return ident.bitwiseAND(F.lit(NR_MASK))


def hex_id(ident: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(ident)), 16, "0"))


def numbered(frame: DataFrame, column: str, start: int, order: list[str] | None = None) -> DataFrame:
    """Running numbers from ``start``, in the given order or that of the partitions.

    Rows are counted per partition; the offsets are one row a partition and are joined by broadcast.
    """
    from ..plans.materialise import materialised

    if order:
        frame = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialised(frame.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first")).orderBy("_p").collect()
    total, rows = start, []
    for r in sizes:
        rows.append((r["_p"], total - r["_first"]))
        total += r["n"]
    offsets = frame.sparkSession.createDataFrame(rows, "_p int, _o long")
    return marked.join(F.broadcast(offsets), "_p").select("*", (F.col("_m") + F.col("_o")).alias(column)).drop("_p", "_m", "_o")
