"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Runs of space, tab, line ends and no-break spaces as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\u00A0]+", " "))


def shortened(text: Column, most: int) -> Column:
    """The first `most` characters of a longer text, and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def and_list(items: Column) -> Column:
    """An array of texts as 'a', 'a and b' or 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def index_ranges(values: Column) -> Column:
    """A sorted array of distinct integers as '1-3, 7'."""
    start = F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.array().cast("array<string>").alias("done"))
    show = lambda s: F.when(s["a"] == s["b"], s["a"].cast("string")).otherwise(F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string")))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("int")
        follows = s["b"] == x - 1
        return F.struct(
            F.when(follows, s["a"]).otherwise(x).alias("a"), x.alias("b"),
            F.when(s["b"].isNull() | follows, s["done"]).otherwise(F.concat(s["done"], F.array(show(s)))).alias("done"),
        )

    return F.aggregate(values, start, step, lambda s: F.array_join(F.when(s["b"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(show(s)))), ", "))
