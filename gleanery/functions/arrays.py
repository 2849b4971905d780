"""In-row array helpers. They keep per-document work inside the document's own row, with no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Like :func:`let` for several values, reached as fields of one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def indices(n: Column) -> Column:
    """``0 .. n-1``; an empty array for 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running_total(values: Column) -> Column:
    """For an array of ints, the sum of the elements *before* each one.

    Two levels of blocks keep the array copying linear in the array length.
    """
    empty = F.array().cast("array<int>")

    def prefix(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("sum"), empty.alias("out"))
        return F.aggregate(
            xs, zero,
            lambda acc, x: F.struct((acc["sum"] + x).cast("int").alias("sum"),
                                    F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
            lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(_BLOCK)).cast("int")
        return F.transform(indices(count), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: (acc + x).cast("int"))

    return let(values, lambda xs: let(blocks(xs), lambda bs: let(
        prefix(F.transform(bs, total), F.lit(0)),
        lambda starts: F.flatten(F.transform(bs, lambda block, i: prefix(block, starts[i]))))))


def running_max(values: Column) -> Column:
    """For an array of ints, the largest element up to and including each one, by blocks as in :func:`running_total`."""
    def upto(xs: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("max"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            top = F.greatest(acc["max"], x)
            return F.struct(top.alias("max"), F.concat(acc["out"], F.array(top)).alias("out"))

        return F.aggregate(xs, zero, step, lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(_BLOCK)).cast("int")
        return F.transform(indices(count), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))

    lowest = F.lit(-2**31)
    long = lambda xs: let(blocks(xs), lambda bs: let(
        upto(F.transform(bs, F.array_max), lowest),
        lambda tops: F.flatten(F.transform(bs, lambda block, i: upto(block, F.coalesce(F.get(tops, i - 1), lowest))))))
    return let(values, lambda xs: F.when(F.size(xs) <= _BLOCK, upto(xs, lowest)).otherwise(long(xs)))


def count_below(values: Column, bound: Column) -> Column:
    """How many elements of a sorted array are less than ``bound``, by halving. ``values`` is read at each step: pass a variable."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        is_open = acc["lo"] < acc["hi"]
        below = F.get(values, middle) < bound
        return F.struct(F.when(is_open & below, middle + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(is_open & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), step, lambda acc: acc["lo"])


def runs(rows: Column, key: str, build: Callable[[Column], Column]) -> Column:
    """Split a *sorted* array of structs into runs of equal ``key`` and map each run with ``build``."""
    def starts(s: Column) -> Column:
        return F.filter(indices(F.size(s)), lambda i: (i == 0) | (s[i][key] != F.get(s, i - 1)[key]))

    return let(rows, lambda s: let(starts(s), lambda b: F.transform(
        b, lambda x, j: let(F.slice(s, x + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - x), build))))
