"""Edit distances and the join keys that find close words by equality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import indices, let, let_all

# Pairs whose tables are worked out side by side.
STEP_PAIRS = 4096


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Levenshtein distance; with ``limit``, anything beyond it is ``limit + 1``."""
    if limit is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def edit_distance_osa(a: Column, b: Column) -> Column:
    """Levenshtein plus swaps of neighbours (optimal string alignment), one table row per character of ``a``."""
    def table(v: Column) -> Column:
        ints = "array<int>"
        start = F.struct(F.lit(0).alias("i"), F.array().cast(ints).alias("above2"),
                         F.sequence(F.lit(0), F.size(v["b"])).cast(ints).alias("above"))

        def next_row(acc: Column, ch: Column) -> Column:
            i = acc["i"]

            def cell(row: Column, j: Column) -> Column:
                other = v["b"][j]
                cost = F.when(ch == other, F.lit(0)).otherwise(F.lit(1))
                best = F.least(F.element_at(row, -1) + 1, acc["above"][j + 1] + 1, acc["above"][j] + cost)
                swap = (i > 0) & (j > 0) & (ch == F.get(v["b"], j - 1)) & (F.get(v["a"], i - 1) == other)
                best = F.when(swap, F.least(best, F.get(acc["above2"], j - 1) + 1)).otherwise(best)
                return F.concat(row, F.array(best))

            row = F.aggregate(indices(F.size(v["b"])), F.array((i + 1).cast("int")), cell)
            return F.struct((i + 1).cast("int").alias("i"), acc["above"].alias("above2"), row.alias("above"))

        return F.aggregate(v["a"], start, next_row, lambda acc: F.element_at(acc["above"], -1))

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    # The table is only needed where a swap can pay off. A swap saves one edit and keeps the letters: with distance d, at most d - 2 other edits
    # are left beside it, each of which moves the sorted letters by at most 2.
    plain = F.levenshtein(a, b)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    pays = (plain >= 2) & (F.levenshtein(letters(a), letters(b)) <= 2 * (plain - 2))
    return F.when(~pays, plain).otherwise(let_all({"a": chars(a), "b": chars(b)}, table))


def _osa_side_by_side(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, limit: int) -> np.ndarray:
    """Optimal string alignment of the rows of two matrices of characters (0 beyond each word), ``limit + 1`` for anything beyond ``limit``: a step for each
    cell of the table near its diagonal, for all pairs at once."""
    far = limit + 1
    rows, width = len(a), b.shape[1]
    above2 = np.full((rows, width + 1), far, np.int32)
    above = np.minimum(np.broadcast_to(np.arange(width + 1, dtype=np.int32), (rows, width + 1)), far).copy()
    out = np.where(la == 0, np.minimum(lb, far), far).astype(np.int32)
    for i in range(1, a.shape[1] + 1):
        here = np.full((rows, width + 1), far, np.int32)
        if i <= limit:
            here[:, 0] = i
        for j in range(max(1, i - limit), min(width, i + limit) + 1):
            cost = (a[:, i - 1] != b[:, j - 1]).astype(np.int32)
            best = np.minimum(np.minimum(here[:, j - 1], above[:, j]) + 1, above[:, j - 1] + cost)
            if i > 1 and j > 1:
                swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swap, np.minimum(best, above2[:, j - 2] + 1), best)
            here[:, j] = np.minimum(best, far)
        above2, above = above, here
        done = la == i
        out[done] = here[done, lb[done]]
    return out


def osa_of_pairs(a: pd.Series, b: pd.Series, limit: int) -> pd.Series:
    la, lb = a.str.len().to_numpy(np.int64), b.str.len().to_numpy(np.int64)
    out = np.full(len(a), limit + 1, np.int32)
    order = np.lexsort((lb, la))
    order = order[np.abs(la - lb)[order] <= limit]

    def points(words: pd.Series) -> np.ndarray:
        return np.array(words.tolist(), dtype=np.str_)[:, None].view(np.uint32).reshape(len(words), -1)

    for at in range(0, len(order), STEP_PAIRS):
        some = order[at: at + STEP_PAIRS]
        x, y = points(a.iloc[some]), points(b.iloc[some])
        # numpy gives words without letters one character; what lies beyond a word is never read as part of it.
        out[some] = _osa_side_by_side(x[:, : la[some].max()], y[:, : lb[some].max()], la[some], lb[some], limit)
    return pd.Series(out)


def osa_within(limit: int) -> Callable[[Column, Column], Column]:
    """A function of two columns: their optimal string alignment distance if it is at most ``limit``, else ``limit + 1``; whole batches at a time."""
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return osa_of_pairs(a, b, limit)

    return distance


def similarity_relative(a: Column, b: Column) -> Column:
    """1 for equal strings, falling with the distance and with the difference in length."""
    longer = F.greatest(F.length(a), F.length(b)).cast("double")
    shorter = F.least(F.length(a), F.length(b)).cast("double")
    return (longer - F.levenshtein(a, b)) / longer * (shorter / longer)


def deletions(word: Column, k: int) -> Column:
    """The word and every string left after up to ``k`` deletions, distinct."""
    def once(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda w: F.transform(indices(F.length(w)), lambda i: F.concat(
            F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))))))

    out = F.array(word)
    for _ in range(k):
        out = let(out, lambda ws: F.array_distinct(F.concat(ws, once(ws))))
    return out
