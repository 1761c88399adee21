"""Array expressions: counts and n-grams inside a row, so no shuffle is needed to build them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it.

    Spark does not extract a Python UDF whose argument holds a lambda that names an outer lambda's
    variable, so keep such bodies out of UDF arguments.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counts(items: Column) -> Column:
    """array<struct<token, tf>>: occurrences of each distinct item, in item order."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, j: F.struct(
                    F.get(ordered, at).alias("token"),
                    (F.coalesce(F.get(s, j + 1), n) - at).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<token:string,tf:int>>")
    return F.when(F.size(items) > 0, let(F.sort_array(items), runs)).otherwise(empty)


def ngrams(items: Column, n: int) -> Column:
    """Consecutive n-tuples joined by U+0001."""
    if n == 1:
        return items
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(items, i, n), "\u0001"),
    )
    return F.when(F.size(items) >= n, windows).otherwise(F.array().cast("array<string>"))


def numbered(items: Column) -> Column:
    """Each item with its occurrence number, which turns a multiset into a set.

    Set intersection of two numbered arrays has min(count, count) members per item, and their
    union has the max: exactly clipped n-gram counting, single or multi reference.
    """
    return F.flatten(
        F.transform(
            counts(items),
            lambda e: F.transform(
                F.sequence(F.lit(1), e["tf"]),
                lambda j: F.concat(e["token"], F.lit("\u0002"), j.cast("string")),
            ),
        )
    )


def shared(left: Column, right: Column) -> Column:
    """Multiset intersection size of two numbered arrays."""
    return F.size(F.array_intersect(left, right))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(vector: Column) -> Column:
    """Vector scaled to length one; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.zip_with(
        vector, F.array_repeat(norm, F.size(vector)), lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    )
