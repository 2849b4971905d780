"""Joins and ranks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.arrays import let_all
from .session import settle, stored

# A table is only ever broadcast after its size was measured against this bound.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 2_000_000
# Copies of the small side made for each hot key.
SALTS = 64


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, to within the rounding of its container."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_width(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return _width(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.MapType, T.ArrayType)):
            inside = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _width(x, kind.elementType))
        else:
            inside = F.size(value) * 8
        return F.coalesce(inside.cast("long"), F.lit(0).cast("long")) + 16
    return F.lit(16)


def measured(df: DataFrame, *also: Column, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS):
    """Whether ``df`` fits a broadcast, and the row of further aggregates ``also``, complete where it fits. One job over at most
    ``max_rows + 1`` rows."""
    width = sum((_width(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields), F.lit(0))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b"), *also).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes, row


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    """Measure ``df`` (one aggregate job over at most ``max_rows + 1`` rows)."""
    return measured(df, max_bytes=max_bytes, max_rows=max_rows)[0]


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                hot: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to a table that is usually small.

    A measured-small right side is broadcast. Otherwise both sides shuffle; keys listed in ``hot`` (a table of
    key columns that is small by construction) are spread over ``SALTS`` tasks and their right rows copied.
    """
    on = list(on)
    if fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    if hot is None or how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        return big.join(small, on, how)
    hot = hot.select(*on).distinct().withColumn("_hot", F.lit(True))
    # A hash of the row, so that a task run again after a lost executor salts its rows the same way.
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int")
    left = (big.join(hot, on, "left")
            .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# Range joins cut the axis into 16 ** CELL_LEVELS cells; a cell of each level holds 16 of the one below it.
CELL_LEVELS = 6


def _cells_of(first: Column, last: Column, level: int = 0) -> Column:
    """Aligned cells [level, number] that together make up the cells ``first`` to ``last`` of this level: at most 30 of each level, however long the range."""
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    if level == CELL_LEVELS:
        return let_all({"a": first, "b": last}, lambda v: F.transform(run(v["a"], v["b"]), _numbered(level)))

    def split(v: Column) -> Column:
        # What is left of and right of the next level's cells that lie wholly inside stays on this one; without any, an empty range goes on.
        whole = v["inner"] <= v["outer"]
        left = run(v["a"], F.when(whole, v["inner"] * 16 - 1).otherwise(v["b"]))
        right = F.when(whole, run((v["outer"] + 1) * 16, v["b"])).otherwise(F.array().cast("array<bigint>"))
        rest = _cells_of(F.when(whole, v["inner"]).otherwise(F.lit(1).cast("long")), F.when(whole, v["outer"]).otherwise(F.lit(0).cast("long")), level + 1)
        return F.concat(F.transform(F.concat(left, right), _numbered(level)), rest)

    inside = lambda v: {"a": v["a"], "b": v["b"], "inner": F.floor((v["a"] + 15) / 16).cast("long"), "outer": (F.floor((v["b"] + 1) / 16) - 1).cast("long")}
    return let_all({"a": first, "b": last}, lambda v: let_all(inside(v), split))


def _numbered(level: int) -> Callable[[Column], Column]:
    return lambda n: F.struct(F.lit(level).alias("level"), n.alias("n"))


def range_join(points: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, condition: Column) -> DataFrame:
    """Pair every point with the ranges that hold it; ``condition`` decides the exact ends.

    A range is a few aligned cells of the axis, at most 30 of each size; a point has one cell of each size, and brings those sizes that any range uses. So
    the join is an equality, each pair meets in one cell only, and long and short ranges cost alike. ``value``, ``lo`` and ``hi`` must be numeric; a null
    end is open, a null point is in no range.
    """
    # Ends may be long expressions; settled, each is worked out once.
    ranges = settle(ranges)
    ends = points.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    a, b = ends["a"] or 0.0, ends["b"] or 0.0
    count = 16 ** CELL_LEVELS
    step = ((b - a) / count) or 1.0

    def cell(col: Column) -> Column:
        place = F.floor((col.cast("double") - F.lit(a)) / F.lit(step))
        return F.greatest(F.lit(0), F.least(F.lit(count - 1), place)).cast("long")

    meets = F.coalesce(F.col(lo).cast("double") <= F.lit(b), F.lit(True)) & F.coalesce(F.col(hi).cast("double") >= F.lit(a), F.lit(True)) \
        & F.coalesce(F.col(lo).cast("double") <= F.col(hi).cast("double"), F.lit(True))
    first = F.when(F.col(lo).isNull(), F.lit(0).cast("long")).otherwise(cell(F.col(lo)))
    last = F.when(F.col(hi).isNull(), F.lit(count - 1).cast("long")).otherwise(cell(F.col(hi)))
    cut = settle(ranges.filter(meets).withColumn("_a", first).withColumn("_b", last).withColumn("_cell", F.explode(_cells_of(F.col("_a"), F.col("_b")))).drop("_a", "_b"))
    used = sorted(r[0] for r in cut.select("_cell.level").distinct().collect())
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(cell(F.col(value)) / 16 ** k).cast("long").alias("n")) for k in used]) if used else F.array().cast("array<struct<level:int,n:bigint>>")
    left = points.filter(F.col(value).isNotNull()).withColumn("_cell", F.explode(own))
    return lookup_join(left, cut, ["_cell"]).filter(condition).drop("_cell")


def wide_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Running totals (up to and including each row) within ``by`` under ``order``, however large a group is.

    Rows are range-partitioned by (group, order) and settled. A row's total is the total inside its partition plus the
    group's totals of earlier partitions, so no group is ever sorted by one task; the table of offsets has at most one row
    per group and partition.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    parts = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    offsets = totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"),
                            *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    same = F.col("_part") == F.col("_k_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts
    for n, e in sums.items():
        out = out.withColumn(f"_r_{n}", F.sum(e).over(inside))
    return out.join(offsets, same).select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def wide_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row within ``by`` under ``order`` (a total order), for groups of any size."""
    return wide_running(df, by, order, {name: F.lit(1).cast("long")})


def next_value(values: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe row (v, probe) the smallest value ``u >= probe``; probes beyond the last value drop out.

    Values and probes are range-partitioned together; a probe looks ahead inside its partition, and where nothing follows
    it takes the first value of the next partition that has one.
    """
    mixed = values.select(F.col("v").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v")) \
        .union(probes.select(F.col("probe").alias("x"), F.lit(0).alias("kind"), F.col("v")))
    parts = settle(mixed.repartitionByRange("x", "kind").withColumn("_part", F.spark_partition_id()))
    # Read backwards, so that a running frame sees what follows; at one place the value comes before the probe.
    seen = Window.partitionBy("_part").orderBy(F.desc("x"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumn("u", F.last(F.when(F.col("kind") == 1, F.col("x")), ignorenulls=True).over(seen)).filter("kind = 0")
    # One row per partition.
    firsts = parts.filter("kind = 1").groupBy("_part").agg(F.min("x").alias("_first"))
    every = parts.select("_part").distinct().join(firsts, "_part", "left")
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("_next", F.last("_first", ignorenulls=True).over(later)).select("_part", "_next")
    return inside.join(F.broadcast(carry), "_part").select("v", F.coalesce("u", "_next").alias("u")).filter("u IS NOT NULL")


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows of each group: every task keeps only its own best ``k`` before the shuffle."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
    return out if name else out.drop(rank)
