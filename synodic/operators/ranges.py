"""Counts and sums over ranges of a column within groups, without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_totals(frame: DataFrame, group: Column, order: Column, reach, value: Column) -> DataFrame:
    """(id, n, s): of the rows of the group with abs(difference of ``order``) < ``reach`` their number and the sum of ``value``.

    Each row asks for running totals below its upper end and up to its lower end. Running totals are taken
    in buckets as wide as ``reach`` and over the totals of buckets, so that no task needs a whole group; the
    work grows with n log n. Rows with a null group or order are in no range.
    """
    rows = frame.select("id", group.alias("g"), order.alias("o"), value.alias("v")).filter("g is not null and o is not null")
    # at one point: totals up to a lower end take the rows that stand there, those below an upper end don't
    events = F.array(
        F.struct(F.col("o").alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("sign"), F.lit(1).cast("long").alias("k"), F.col("v").alias("x")),
        F.struct((F.col("o") - reach).cast(rows.schema["o"].dataType).alias("at"), F.lit(2).alias("rank"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("k"), F.lit(None).cast(rows.schema["v"].dataType).alias("x")),
        F.struct((F.col("o") + reach).cast(rows.schema["o"].dataType).alias("at"), F.lit(0).alias("rank"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("k"), F.lit(None).cast(rows.schema["v"].dataType).alias("x")),
    )
    every = rows.select("id", "g", F.explode(events).alias("e")).select("id", "g", "e.*").withColumn("b", F.floor(F.col("at") / F.lit(reach)))
    totals = every.filter("sign = 0").groupBy("g", "b").agg(F.sum("k").alias("bk"), F.sum("x").alias("bx"))
    asked = every.select("g", "b").distinct().join(totals, ["g", "b"], "left")
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each bucket of a group
    asked = asked.select("g", "b", F.coalesce(F.sum("bk").over(before), F.lit(0)).alias("bk"), F.coalesce(F.sum("bx").over(before), F.lit(0)).alias("bx"))
    inside = Window.partitionBy("g", "b").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    run = every.select("id", "g", "b", "sign", F.sum("k").over(inside).alias("rk"), F.sum("x").over(inside).alias("rx")).filter("sign != 0")
    found = run.join(asked, ["g", "b"]).select("id", "sign", (F.col("rk") + F.col("bk")).alias("n"), (F.coalesce("rx", F.lit(0)) + F.col("bx")).alias("s"))
    return found.groupBy("id").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("s")).alias("s"))
