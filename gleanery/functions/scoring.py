"""Scoring models: column arithmetic over one posting and its statistics.

A model is called with a :class:`Stats` of columns: ``tf`` (posting weight), ``doc_len``, ``df``, ``cf``, ``n_docs``,
``avg_len`` and ``total_len``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    tf: Column
    doc_len: Column
    df: Column
    cf: Column
    n_docs: Column
    avg_len: Column
    total_len: Column
    field: Column
    positions: Column


Model = Callable[[Stats], Column]


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(n_docs / (df + 1)) + 1


@dataclass(frozen=True)
class BM25:
    """``b`` may be given per field through ``field_b``."""

    b: float = 0.75
    k1: float = 1.2
    field_b: Mapping[str, float] = field(default_factory=dict)

    def __call__(self, s: Stats) -> Column:
        b: Column = F.lit(self.b)
        for name, value in self.field_b.items():
            b = F.when(s.field == name, F.lit(value)).otherwise(b)
        norm = (1 - b) + b * s.doc_len / s.avg_len
        return idf(s.n_docs, s.df) * (s.tf * (self.k1 + 1)) / (s.tf + self.k1 * norm)


def tf_idf(s: Stats) -> Column:
    return s.tf * idf(s.n_docs, s.df)


def frequency(s: Stats) -> Column:
    return s.tf


def dfree(s: Stats) -> Column:
    """Divergence from randomness without parameters."""
    prior = s.tf / s.doc_len
    post = (s.tf + 1.0) / (s.doc_len + 1.0)
    rarity = s.total_len / s.cf
    gain = F.ln(post / prior)
    return s.tf * gain * (s.tf * F.ln(prior * rarity) + (s.tf + 1.0) * F.ln(post * rarity) + 0.5 * gain)


@dataclass(frozen=True)
class PL2:
    """Poisson estimate with Laplace normalisation."""

    c: float = 1.0

    def __call__(self, s: Stats) -> Column:
        log2e = 1.0 / math.log(2)
        tfn = s.tf * F.ln(1.0 + (self.c * s.avg_len) / s.doc_len)
        f = s.cf / s.n_docs
        return (tfn * F.ln(1.0 / f) + f * log2e + 0.5 * F.ln(2 * math.pi * tfn) + tfn * (F.ln(tfn) - log2e)) / (tfn + 1.0)


@dataclass(frozen=True)
class ByField:
    """The model is chosen by field."""

    default: Model
    fields: Mapping[str, Model]

    def __call__(self, s: Stats) -> Column:
        out = self.default(s)
        for name, model in self.fields.items():
            out = F.when(s.field == name, model(s)).otherwise(out)
        return out


@dataclass(frozen=True)
class Reverse:
    """The opposite order of another model."""

    model: Model

    def __call__(self, s: Stats) -> Column:
        return -self.model(s)


# ---- term expansion models (weights in a document set against the collection) ---------------------------------

def log2(x: Column) -> Column:
    return F.ln(x) / math.log(2)


@dataclass(frozen=True)
class Bo1:
    def score(self, w: Column, cf: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        f = cf / n_docs
        return w * log2((1.0 + f) / f) + log2(1.0 + f)

    def norm(self, top: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        f = top / n_docs
        return (top * F.ln((1.0 + f) / f) + F.ln(1.0 + f)) / math.log(2)


@dataclass(frozen=True)
class Bo2:
    def score(self, w: Column, cf: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        f = w * top_total / total
        return w * log2((1.0 + f) / f) + log2(1.0 + f)

    def norm(self, top: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        f = top * n_docs / total
        return top * log2((1.0 + f) / f) + log2(1.0 + f)


@dataclass(frozen=True)
class KL:
    def score(self, w: Column, cf: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        here, there = w / top_total, cf / total
        return F.when(here < there, F.lit(0.0)).otherwise(here * log2(here / (w / total)))

    def norm(self, top: Column, top_total: Column, n_docs: Column, total: Column) -> Column:
        return top * F.ln(total / top_total) / math.log(2) * top_total
