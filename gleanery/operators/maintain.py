"""Keyed table maintenance. Every operator returns a new DataFrame; small change sets leave the table unshuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import lookup_join


def last_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key; each task first keeps its own last row, so a busy key costs one row per task."""
    packed = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(key).agg(packed.alias("_r")).select("_r.*")


def upsert(table: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with an updated key are replaced, new keys added; in one batch the last update (by ``order``) wins."""
    newest = last_per_key(updates, key, [order])
    kept = lookup_join(table, newest.select(key), [key], "left_anti")
    return kept.unionByName(newest.select(*table.columns))


def delete_by_term(table: DataFrame, column: str, value) -> DataFrame:
    """Rows that do not hold the value (in the column, or in its list)."""
    holds = F.array_contains(column, value) if dict(table.dtypes)[column].startswith("array") else F.col(column) == F.lit(value)
    return table.filter(~F.coalesce(holds, F.lit(False)))


def delete_by_query(table: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return lookup_join(table, hits.select(F.col(hits.columns[0] if key not in hits.columns else key).alias(key)).distinct(), [key], "left_anti")


def deleted_count(table: DataFrame, remaining: DataFrame) -> DataFrame:
    before, after = table.agg(F.count(F.lit(1)).alias("a")), remaining.agg(F.count(F.lit(1)).alias("b"))
    return before.join(F.broadcast(after)).select((F.col("a") - F.col("b")).alias("deleted"))


def _spec(spec: Mapping | Column | None) -> Column:
    if spec is None:
        return F.lit(True)
    if isinstance(spec, Column):
        return spec
    test = F.lit(True)
    for column, value in spec.items():
        test = test & F.col(column).eqNullSafe(F.lit(value))
    return test


def update_fields(table: DataFrame, spec, changes: Mapping[str, object], multi: bool = True, key: str | None = None) -> DataFrame:
    """Set columns where ``spec`` matches; only the first match by ``key`` unless ``multi``."""
    where = _spec(spec)
    if not multi:
        first = table.filter(where).agg(F.min(key).alias("_first"))
        table = table.join(F.broadcast(first))
        where = where & (F.col(key) == F.col("_first"))
    hit = table.withColumn("_hit", where)
    for column, value in changes.items():
        value = value if isinstance(value, Column) else F.lit(value)
        hit = hit.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)) if column in table.columns else F.when(F.col("_hit"), value))
    return hit.drop("_hit", "_first")


def insert_unique(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Append rows whose key is not present yet; of rows with one new key the first (by ``order``) stays."""
    packed = F.min_by(F.struct(*rows.columns), F.col(order or key))
    new = rows.groupBy(key).agg(packed.alias("_r")).select("_r.*")
    known = table.select(key)
    return table.unionByName(new.join(known, key, "left_anti").select(*table.columns))


def find(table: DataFrame, spec=None, fields: Sequence[str] | None = None, sort: Sequence[tuple[str, int]] = (), skip: int = 0,
         limit: int | None = None) -> DataFrame:
    """Filter, project, order (1 up, -1 down), slice."""
    out = table.filter(_spec(spec))
    if sort:
        out = out.orderBy(*[F.col(c).asc() if d > 0 else F.col(c).desc() for c, d in sort])
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out


def find_one(table: DataFrame, spec=None, fields: Sequence[str] | None = None, sort: Sequence[tuple[str, int]] = ()) -> DataFrame:
    return find(table, spec, fields, sort, limit=1)


def count_rows(table: DataFrame, spec=None) -> DataFrame:
    return table.filter(_spec(spec)).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(table: DataFrame, column: str, spec=None) -> DataFrame:
    """Distinct values; lists are unwound."""
    rows = table.filter(_spec(spec))
    value = F.explode(F.col(column)) if dict(table.dtypes)[column].startswith("array") else F.col(column)
    return rows.select(value.alias("value")).distinct()


def group_reduce(table: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], condition=None, finalize: Mapping[str, Column] | None = None) -> DataFrame:
    """Filter, group, fold with aggregate columns, finish with column expressions."""
    out = table.filter(_spec(condition)).groupBy(*keys).agg(*aggregates)
    for name, expr in (finalize or {}).items():
        out = out.withColumn(name, expr)
    return out


def find_and_modify(table: DataFrame, spec, changes: Mapping[str, object] | None, sort: Sequence[tuple[str, int]], key: str,
                    remove: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Change (or remove) the first match in ``sort`` order: (table after, old row, new row)."""
    order = [(c, d) for c, d in sort] + [(key, 1)]
    old = find_one(table, spec, sort=order)
    first = old.select(F.col(key).alias("_key"))
    if remove:
        return table.join(F.broadcast(first), table[key] == F.col("_key"), "left_anti"), old, old.filter(F.lit(False))
    marked = table.join(F.broadcast(first), table[key] == F.col("_key"), "left")
    after = update_fields(marked, F.col("_key").isNotNull(), changes or {}).drop("_key")
    new = update_fields(old, None, changes or {})
    return after, old, new
