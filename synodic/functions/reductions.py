"""Reductions and what they give over no rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MAX = 2**63 - 1
OPS = ("+", "*", "max", "min", "&", "|")


def identity(op: str, kind: T.DataType):
    """Over no rows; the bitwise and over integers has all bits set, so that signs survive."""
    boolean, whole = isinstance(kind, T.BooleanType), isinstance(kind, T.IntegralType)
    if op == "max":
        return -INT_MAX if whole else float("-inf")
    if op == "min":
        return INT_MAX if whole else float("inf")
    if op in ("+", "*"):
        return int(op == "*") if whole or boolean else float(op == "*")
    if op == "&":
        return True if boolean else -1
    if op == "|":
        return False if boolean else 0
    raise ValueError(f"a reduction by {op!r} needs an init value")


def aggregate(op: str, value: Column, kind: T.DataType) -> Column:
    boolean = isinstance(kind, T.BooleanType)
    if op == "+":
        return F.sum(value.cast("long") if boolean else value)
    if op == "*":
        return F.product(value)
    if op in ("max", "min"):
        return getattr(F, op)(value)
    return {("&", True): F.bool_and, ("|", True): F.bool_or, ("&", False): F.bit_and, ("|", False): F.bit_or}[op, boolean](value)


def whole_product(frame: DataFrame, value: Column) -> int:
    """Exact product of integers in 64 bits: one factor comes back from each partition."""

    def run(parts):
        out = np.int64(1)
        with np.errstate(over="ignore"):
            for part in parts:
                out = out * np.multiply.reduce(part["v"].to_numpy(dtype=np.int64), initial=np.int64(1))
        yield pd.DataFrame({"v": [out]})

    factors = [np.int64(r[0]) for r in frame.select(value.cast("long").alias("v")).dropna().mapInPandas(run, "v long").collect()]
    with np.errstate(over="ignore"):
        return int(reduce(lambda a, b: a * b, factors, np.int64(1)))
