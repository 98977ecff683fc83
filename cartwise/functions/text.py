"""List <-> text helpers (rule sides, model drivers) and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise.functions.clean import js_trim

LIST_SEPARATOR = ", "


def join_list(items: Column | str, sort: bool = True) -> Column:
    """``["MILK", "BREAD"]`` -> ``"BREAD, MILK"`` (sorted by name unless ``sort=False``)."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_join(F.array_sort(c) if sort else c, LIST_SEPARATOR)


def split_list(text: Column | str) -> Column:
    """Split on commas, trim every part, drop empty parts."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: js_trim(x))
    return F.filter(parts, lambda x: x != "")


def decimal_text(c: Column | str) -> Column:
    """Decimal rendered without trailing zeros (``1.00`` -> ``1``, ``0.50`` -> ``0.5``)."""
    col = F.col(c) if isinstance(c, str) else c
    s = col.cast("string")
    return F.when(F.instr(s, ".") > 0,
                  F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)
