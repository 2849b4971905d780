"""Span algebra against every a held against every b, and on long lists."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions import spans as S
from gleanery.functions.arrays import count_below, running_max

ROW = f"a {S.SPANS}, b {S.SPANS}"


def _lists(seed, n=60):
    rng = random.Random(seed)
    def some():
        return [(s, s + rng.choice([0, 0, 1, 2, 7])) for s in (rng.randrange(40) for _ in range(rng.choice([0, 1, 2, 5, 9, 20])))]
    return [(some(), some()) for _ in range(n)]


def _distance(x, y):
    return 0 if x[0] <= y[1] and x[1] >= y[0] else (y[0] - x[1] if x[1] < y[0] else x[0] - y[1])


def _got(spark, rows, expression):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, " + ROW)
    return [[tuple(x) for x in r.o] for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("slop,ordered,mindist", [(1, True, 1), (4, True, 2), (5, False, 1), (3, False, 0), (3, True, 0), (0, False, 0), (0, True, 1)])
def test_near(spark, slop, ordered, mindist):
    rows = _lists(slop + 10 * ordered)
    def plain(a, b):
        pairs = [(x, y) for x, y in itertools.product(a, b) if mindist <= _distance(x, y) <= slop and (not ordered or x[0] <= y[0])]
        return sorted({(min(x[0], y[0]), max(x[1], y[1])) for x, y in pairs})
    assert _got(spark, rows, S.near(F.col("a"), F.col("b"), slop, ordered, mindist)) == [plain(a, b) for a, b in rows]


def test_merge_free_and_around(spark):
    rows = _lists(3)
    def merged(a):
        places = sorted({p for s, e in a for p in range(s, e + 1)})
        out = []
        for p in places:
            if out and out[-1][1] == p - 1:
                out[-1] = (out[-1][0], p)
            else:
                out.append((p, p))
        return out
    assert _got(spark, rows, S.merge(F.col("a"))) == [merged(a) for a, _ in rows]
    assert _got(spark, rows, S.free_of(F.col("a"), F.col("b"))) == [[x for x in a if all(_distance(x, y) for y in b)] for a, b in rows]
    assert _got(spark, rows, S.around(F.col("a"), F.col("b"))) == [[x for x in a if any(y[0] >= x[0] and y[1] <= x[1] for y in b)] for a, b in rows]


def test_running_max_and_count_below(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(-50, 50) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 700)]
    df = spark.createDataFrame([(xs, sorted(xs)) for xs in lists], "xs array<int>, s array<int>")
    bounds = [-60, -3, 0, 7, 60]
    rows = df.select(running_max(F.col("xs")).alias("m"), F.array(*[count_below(F.col("s"), F.lit(b)) for b in bounds]).alias("c")).collect()
    assert [r.m for r in rows] == [list(itertools.accumulate(xs, max)) for xs in lists]
    assert [r.c for r in rows] == [[sum(x < b for x in xs) for b in bounds] for xs in lists]


def test_time_follows_the_spans(spark):
    """Two words by turns: eight times the text takes nothing like 64 times as long."""
    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.span(2 * i, 2 * i)).alias("a"),
                                   F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.span(2 * i + 1, 2 * i + 1)).alias("b"))
        out = df.select(S.near(F.col("a"), F.col("b"), 1).alias("n"), S.free_of(F.col("a"), F.col("b")).alias("f"), S.around(F.col("a"), F.col("b")).alias("c"),
                        S.merge(F.concat("a", "b")).alias("m"))
        start = time.time()
        r = out.select(F.size("n").alias("n"), F.size("f").alias("f"), F.size("c").alias("c"), F.size("m").alias("m")).first()
        assert (r.n, r.f, r.c, r.m) == (n, n, 0, 1)
        return time.time() - start

    seconds(1_250)
    small, large = seconds(1_250), seconds(10_000)
    assert large < 24 * small + 2
