"""Mixing sources to target weights: a budget is handed down a tree of domains, languages and sources.

Each node shares its budget among its children by weight, but no child gets more than its whole subtree can give; what a child
leaves is shared among its siblings. As a child's limit counts its whole subtree, a shortage is made up among siblings first
and moves up to the ancestors' siblings only when the subtree is used up. A leaf then takes whole epochs and a prefix of the next
one, each in a seeded order of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.joins import wide_running

from .common import quoted, settle

NONE = "(none)"


def _kind_of_text(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(" | ")), "tabular").otherwise("prose")


@dataclass(frozen=True)
class Mix:
    """Whole-number weights of the children at each level (``default_weight`` where a name is not listed), the share of the available
    tokens that makes up the budget, in percent (or ``budget`` tokens outright), the epochs that a document may be used
    in, and the seed."""

    domains: dict[str, int] = field(default_factory=lambda: {"prose": 9, "tabular": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    percent: int = 100
    budget: int | None = None
    max_epochs: int = 2
    seed: int = 42


def _weight(name: str, listed: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in listed.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out.cast("bigint")


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Children (parent..., name, cap, weight, _budget of the parent) with ``_given``: min(cap, weight * level), where the level uses up
    the parent's budget, in whole tokens rounded down.

    Sorted by cap / weight, the children that their cap holds back come first; ``level`` is fixed by the first child that it does
    not. A weight of 0 gives nothing.
    """
    by = Window.partitionBy(*parent).orderBy(F.expr("cast(cap as double) / weight"), name) if parent else Window.partitionBy(F.lit(0)).orderBy(F.expr("cast(cap as double) / weight"), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = nodes.filter("weight > 0").withColumn("_rest", F.greatest(F.lit(0), F.col("_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))).withColumn("_w", F.sum("weight").over(after))
    rows = rows.withColumn("_full", F.col("cap") * F.col("_w") <= F.col("_rest") * F.col("weight"))
    first = F.min(F.when(~F.col("_full"), F.struct(F.expr("cast(cap as double) / weight").alias("r"), F.col(name).alias("n"), F.col("_rest").alias("rest"), F.col("_w").alias("w")))).over(every)
    rows = rows.withColumn("_first", first)
    return rows.withColumn("_given", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("(weight * _first.rest) div _first.w")))).drop("_rest", "_w", "_full", "_first")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, given) of leaves (domain, lang, source, tokens). One row a leaf, whatever the number of documents."""
    cap = (F.col("tokens") * mix.max_epochs).alias("cap")
    rows = leaves.select("domain", "lang", "source", "tokens", cap)
    langs = rows.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = rows.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = rows.agg((F.expr(f"sum(tokens) * {mix.percent} div 100") if mix.budget is None else F.lit(mix.budget)).cast("bigint").alias("_budget"))
    top = share(domains.crossJoin(total).withColumn("weight", _weight("domain", mix.domains, mix.default_weight)), [], "domain").select("domain", F.col("_given").alias("_budget"))
    mid = share(langs.join(top, "domain").withColumn("weight", _weight("lang", mix.langs, mix.default_weight)), ["domain"], "lang").select("domain", "lang", F.col("_given").alias("_budget"))
    low = share(rows.join(mid, ["domain", "lang"]).withColumn("weight", _weight("source", mix.sources, mix.default_weight)), ["domain", "lang"], "source")
    return low.select("domain", "lang", "source", "tokens", F.col("_given").alias("given"))


def select(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
           domain: Column | None = None) -> DataFrame:
    """(key, domain, lang, source, tokens, epoch): one row for each use of a document.

    Tokens are the contract's words. A leaf's budget buys whole epochs and then the longest prefix of the next epoch's order that
    fits; documents of no tokens cost nothing and stand where the order puts them. Running totals are made over ranges of (leaf,
    order), so that a leaf of any size is spread over many tasks, and only (key, leaf, tokens) is moved.

    Null languages and sources form leaves of their own, named "(none)"; null texts have no tokens; repeated rows count each (their
    order within an epoch is fixed by the key, so equal keys stand together); other columns are left out. An empty table gives an
    empty result.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(quoted(text)), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    kind = domain if domain is not None else _kind_of_text(F.coalesce(F.col(quoted(text)), F.lit("")))
    docs = settle(df.select(F.col(quoted(key)).alias("_id"), F.coalesce(kind, F.lit(NONE)).alias("domain"), F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(NONE)).alias("lang"),
                            F.coalesce(F.col(quoted(source)).cast("string"), F.lit(NONE)).alias("source"), words.alias("tokens")))
    leaves = docs.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens"))
    plan = settle(budgets(leaves, mix).withColumn("_whole", F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(mix.max_epochs))).withColumn("_left", F.col("given") - F.col("_whole") * F.col("tokens")))
    leaf = ["domain", "lang", "source"]
    joined = docs.join(plan.select(*leaf, "_whole", "_left"), leaf)
    whole = joined.filter("_whole > 0").select("_id", *leaf, "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)).alias("epoch"))
    part = joined.filter((F.col("_whole") < mix.max_epochs) & (F.col("_left") > 0))
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_whole").cast("string"), F.col("_id").cast("string")))
    part = wide_running(part.withColumn("_order", order), leaf, [F.col("_order"), F.col("tokens")], {"_used": F.col("tokens")})
    prefix = part.filter("_used <= _left").select("_id", *leaf, "tokens", F.col("_whole").alias("epoch"))
    return whole.unionByName(prefix).select(F.col("_id").alias(key), *leaf, "tokens", F.col("epoch").cast("int").alias("epoch"))
