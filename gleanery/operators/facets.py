"""Facets, grouping and collapsing over rows (query_id, doc_id, score, facet columns...).

Groups are returned as counts or as rows, never as one list per group, so a group may hold any share of the hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import best_per_group, range_join, wide_rank
from .ranking import by_score


def facet_field(rows: DataFrame, column: str) -> DataFrame:
    """Rows with their group; a missing value is the null group."""
    return rows.withColumn("facet", F.col(column))


def facet_overlap(rows: DataFrame, column: str) -> DataFrame:
    """One row per value of an array column."""
    return rows.withColumn("facet", F.explode_outer(column))


def facet_stored(rows: DataFrame, column: str, allow_overlap: bool = False, split: str = r"\s+") -> DataFrame:
    if not allow_overlap:
        return facet_field(rows, column)
    words = F.filter(F.split(F.col(column), split), lambda w: w != "")
    return rows.withColumn("facet", F.explode_outer(words))


def facet_query(rows: DataFrame, named: Sequence[tuple[str, Column]], other: str | None = None, allow_overlap: bool = False) -> DataFrame:
    """Group by the first matching named condition (or by all of them), else ``other``."""
    if allow_overlap:
        names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]), lambda n: n.isNotNull())
        return rows.withColumn("facet", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(other)))))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, cond in named:
        chain = chain.when(cond, F.lit(name))
    return rows.withColumn("facet", chain.otherwise(F.lit(other)))


def range_buckets(start, end, gaps: Sequence, hardend: bool = False) -> list[tuple]:
    """[lo, hi) buckets from a list of gaps, the last of which repeats; ``hardend`` clamps the last bucket."""
    out, low, i = [], start, 0
    while low < end:
        high = low + gaps[min(i, len(gaps) - 1)]
        if hardend:
            high = min(high, end)
        out.append((low, high))
        low, i = high, i + 1
    return out


def facet_range(rows: DataFrame, column: str, start, end, gaps: Sequence, hardend: bool = False) -> DataFrame:
    """Adds ``lo`` and ``hi`` of the bucket; values outside every bucket get nulls. The gaps but the last give a bucket each; the last one goes on to
    the end, by arithmetic."""
    v = F.col(column)
    listed, rest = [], start
    for g in gaps[:-1]:
        if rest >= end:
            break
        listed.append((rest, min(rest + g, end) if hardend else rest + g))
        rest = listed[-1][1]
    gap = gaps[-1]
    last = end if hardend else rest + -(-(end - rest) // gap) * gap
    low = F.lit(rest) + F.floor((v - F.lit(rest)) / F.lit(gap)) * F.lit(gap)
    high = F.least(low + F.lit(gap), F.lit(end)) if hardend else low + F.lit(gap)
    tail = (v >= F.lit(rest)) & (v < F.lit(last))
    lo, hi = F.when(tail, low), F.when(tail, high)
    if listed:
        ends = F.array(*[F.lit(float(a)) for a, _ in listed], F.lit(float(rest)))
        at = F.size(F.filter(ends, lambda e: e <= v))
        inside = (v >= F.lit(start)) & (v < F.lit(rest))
        lo, hi = F.when(inside, F.get(ends, at - 1)).otherwise(lo), F.when(inside, F.get(ends, at)).otherwise(hi)
    return rows.withColumn("lo", lo.cast("double")).withColumn("hi", hi.cast("double"))


def _micros(moment: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment.cast("timestamp_ntz"))


def facet_date_range(rows: DataFrame, column: str, start: str, end: str, step: str, hardend: bool = False) -> DataFrame:
    """Date buckets of one step, months and other uneven ones too. Rows meet the buckets by equality on cells of the time axis, however many there are."""
    first, last = F.expr(f"timestamp_ntz'{start}'"), F.expr(f"timestamp_ntz'{end}'")
    grid = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {step}"))).alias("lo")).filter(F.col("lo") < last)
    upper = F.col("lo") + F.expr(f"interval {step}")
    grid = grid.withColumn("hi", F.least(upper, last) if hardend else upper)
    grid = grid.withColumn("_lo", _micros(F.col("lo"))).withColumn("_hi", _micros(F.col("hi")))
    points = rows.withColumn("_at", _micros(F.col(column)))
    return range_join(points, "_at", grid, "_lo", "_hi", (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).drop("_at", "_lo", "_hi")


def facets_many(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Several independent groupings in one pass: (query_id, facet_name, facet, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet_name"), F.col(c).cast("string").alias("facet")) for c in columns])
    return rows.select("query_id", F.explode(pairs).alias("p")).groupBy("query_id", "p.facet_name", "p.facet") \
        .agg(F.count(F.lit(1)).alias("n"))


def facet_count(faceted: DataFrame) -> DataFrame:
    return faceted.groupBy("query_id", "facet").agg(F.count(F.lit(1)).alias("n"))


def facet_aggregate(faceted: DataFrame, *aggregates: Column) -> DataFrame:
    """Any aggregate per group."""
    return faceted.groupBy("query_id", "facet").agg(*aggregates)


def facet_best(faceted: DataFrame, key: Column | None = None) -> DataFrame:
    """The best document of each group: lowest key (default: highest score), then lowest doc id."""
    order = F.struct((key if key is not None else -F.col("score")).alias("k"), F.col("doc_id").alias("d"))
    return faceted.groupBy("query_id", "facet").agg(F.min_by("doc_id", order).alias("doc_id"))


def facet_ordered(faceted: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows with their place inside the group in result order."""
    return wide_rank(faceted, ["query_id", "facet"], order or by_score(), "place").select("query_id", "facet", "place", "doc_id")


def facet_unordered(faceted: DataFrame) -> DataFrame:
    return faceted.select("query_id", "facet", "doc_id")


def collapse(rows: DataFrame, column: str, limit: int = 1, order: Sequence[Column] | None = None) -> DataFrame:
    """Keep the best ``limit`` rows per query and key, by score or by ``order``; rows with a null key all stay."""
    keyed = best_per_group(rows.filter(F.col(column).isNotNull()), ["query_id", column], order or by_score(), limit)
    return keyed.union(rows.filter(F.col(column).isNull()))


def collapsed_counts(rows: DataFrame, column: str, limit: int = 1) -> DataFrame:
    """How many rows per key a collapse removes."""
    n = F.count(F.lit(1))
    return (rows.filter(F.col(column).isNotNull()).groupBy("query_id", column).agg((n - F.least(n, F.lit(limit))).alias("removed"))
            .filter("removed > 0"))


def unique_by_org(rows: DataFrame, org: str, key: str, limit: int) -> DataFrame:
    """The newest row (highest key) of each org, newest first."""
    newest = rows.groupBy(org).agg(F.max_by(F.struct(*rows.columns), key).alias("r")).select("r.*")
    return newest.orderBy(F.desc(key)).limit(limit)


def matched_terms(hits: DataFrame) -> DataFrame:
    """Which terms hit which document: (query_id, doc_id, term) from hits that carry ``term``."""
    return hits.select("query_id", "doc_id", "term").distinct()


def docs_per_term(hits: DataFrame) -> DataFrame:
    return matched_terms(hits).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("docs"))
