"""Fixed-width text and enumerations as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_width(value: Column, n: int) -> Column:
    """At most n bytes of UTF-8, without zero bytes and spaces at the end."""
    cut = F.decode(F.substring(F.encode(value, "UTF-8"), 1, n), "UTF-8")
    return F.rtrim(F.translate(cut, "\x00", ""))


def enum_to_int(value: Column, names: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(names):
        out = F.when(value == name, k).otherwise(out)
    return out


def int_to_enum(value: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), value + 1)


def struct_of(**columns: Column) -> Column:
    """A struct of the columns, named: how named tuples are stored."""
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def named_tuples(name: str, rows: list, field: str) -> list:
    """The struct column of collected rows as named tuples."""
    from collections import namedtuple

    if not rows:
        return []
    kind = namedtuple(name, rows[0][field].__fields__)
    return [kind(*r[field]) for r in rows]
