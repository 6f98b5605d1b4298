"""Greedy packing of ordered items as one fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.text import word_count


def greedy(items: Column, limit: int, fixed_words: Column | int = 0, max_items: int | None = None) -> Column:
    """Groups of consecutive items whose words, with ``fixed_words`` around, stay within ``limit``.

    An item joins the current group if that is empty or stays within the limit (and
    within ``max_items``); else it opens a new one. One oversized item is a group of
    its own. Result: array of arrays; empty for an empty array, null for null.
    """
    fixed = fixed_words if isinstance(fixed_words, Column) else F.lit(fixed_words)
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("words")
    )

    def add(state: Column, item: Column) -> Column:
        w = word_count(item)
        full = state["words"] + w + fixed > limit
        if max_items is not None:
            full = full | (F.size(state["open"]) >= max_items)
        flush = (F.size(state["open"]) > 0) & full
        return F.struct(
            F.when(flush, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(flush, F.array(item)).otherwise(F.concat(state["open"], F.array(item))).alias("open"),
            F.when(flush, w).otherwise(state["words"] + w).alias("words"),
        )

    return F.aggregate(
        items, start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    )
