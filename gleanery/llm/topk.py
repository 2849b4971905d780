"""Exact top-k by inner product with a vector-approximation file.

Each component is quantised into one of ``2 ** bits`` cells. A scan of the cells bounds every score from both sides; only
vectors whose upper bound reaches the k-th best lower bound are read in full, best bound first, until no vector left unread
can enter the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, settle

BITS, SCALE = 8, 64
DATA_ROWS, QUERY_ROWS = 32_768, 4_096    # rows of a block of the grid; a task holds one block of either kind
_STEP = 256                              # queries scanned at once


def _prepared(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, v): v holds floor(scale * x) of each component as little-endian doubles. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without a key."""
    x = F.col("_v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = only(df, id=key, _v=vector).filter(F.col("id").isNotNull() & x.isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", F.transform("_v", lambda c: c.cast("double")).alias("_v"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("_v")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * flat), -1e300, 1e300) + 0.0   # no negative zero: equal vectors have equal bytes
            data = [whole[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            low, high = (np.array([f(whole[a:b], initial=s) for a, b in zip(ends[:-1], ends[1:], strict=True)], float) for f, s in ((np.min, math.inf), (np.max, -math.inf)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends).astype(np.int32)), pa.array(data, pa.binary()), pa.array(low), pa.array(high)],
                                             names=["id", "dim", "v", "low", "high"])

    return rows.mapInArrow(run, f"id {kind}, dim int, v binary, low double, high double")


def _scores(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Exact inner products of paired integer-valued rows, held inside 64 bits."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2 ** 53:
        return [int(s) for s in np.einsum("ij,ij->i", q, v)]
    exact = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True))
    return [max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact]


def _scan(low: float, width: float, k: int):
    """The work of one cell of the grid: bounds of all its scores, and what the k best lower bounds leave."""
    half = (width - 1) / 2

    def run(table: pa.Table) -> pa.Table:
        ids, dims, asks = (table.column(c).to_numpy() for c in ("id", "dim", "ask"))
        data = table.column("data").to_pylist()
        out: list[list] = [[], [], [], []]
        for dim in np.unique(dims[asks]):
            mine, theirs = np.flatnonzero(asks & (dims == dim)), np.flatnonzero(~asks & (dims == dim))
            if not len(theirs):
                continue
            cells = np.frombuffer(b"".join(data[i] for i in theirs), np.uint8).reshape(len(theirs), dim).astype(float)
            centre = low + cells * width + half
            for at in range(0, len(mine), _STEP):
                part = mine[at: at + _STEP]
                q = np.frombuffer(b"".join(data[i] for i in part), "<f8").reshape(len(part), dim)
                mid = q @ centre.T
                # Besides the cell's half width: what rounding may add to a sum of doubles.
                slack = half * np.abs(q).sum(1) + 1e-12 * (np.abs(q).sum(1) * float(np.abs(centre).max(initial=0)))
                if len(theirs) > k:
                    least = np.partition(mid, len(theirs) - k, axis=1)[:, len(theirs) - k] - slack
                else:
                    least = np.full(len(part), -math.inf)
                r, c = np.nonzero(mid + slack[:, None] >= least[:, None])
                out[0].append(ids[part[r]])
                out[1].append(ids[theirs[c]])
                out[2].append(mid[r, c] - slack[r])
                out[3].append(mid[r, c] + slack[r])
        names = ["q", "c", "lower", "upper"]
        return pa.table({n: np.concatenate(x) if x else np.empty(0, np.int64 if n in "qc" else float) for n, x in zip(names, out, strict=True)})

    return run


def _best(by: str, order: list[Column], k: int, name: str = "_r") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def search(df: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``asks`` (over the integer ``key``) holds, the ``k`` other rows with the
    highest integer inner product, ties to the smaller key; fewer where there are no more.

    Equal vectors are one class, scanned once, whose ``k + 1`` smallest keys stand in every result. Classes and the classes that
    ask are dealt into blocks; each pair of blocks is one task. Vectors of different lengths are no candidates of each
    other. A row that repeats key and vector counts once; rows that share a key are never each other's result. Scores beyond
    64 bits are held at the limit. An empty table gives an empty result.
    """
    rows = settle(_prepared(df, key, vector, scale))
    one = Window.partitionBy("dim", "v")
    members = rows.withColumn("_r", F.dense_rank().over(one.orderBy("id"))).filter(F.col("_r") <= k + 1).withColumn("c", F.min("id").over(one)).select("c", "id", "dim", "v").distinct()
    members = settle(members)
    classes = members.filter("id = c").select("c", "dim", "v")
    queries = rows.filter(asks(F.col("id")) if callable(asks) else asks).select("id", "dim", "v").distinct()
    queries = queries.join(classes, ["dim", "v"]).select(F.col("id").alias("query_id"), F.col("c").alias("q"))
    queries = settle(queries)
    asked = queries.select("q").distinct().join(classes.withColumnRenamed("c", "q"), "q")
    n_classes, n_asked = classes.count(), asked.count()
    ends = rows.agg(F.min("low"), F.max("high")).first()
    low, high = (ends[0], ends[1]) if n_classes and ends[0] is not None and math.isfinite(ends[0]) else (0.0, 0.0)
    width = max(1.0, math.ceil((high - low + 1) / 2 ** bits))
    blocks, ask_blocks = max(1, math.ceil(n_classes / DATA_ROWS)), max(1, math.ceil(n_asked / QUERY_ROWS))

    def cells(batches):
        for batch in batches:
            data = [np.clip((np.frombuffer(x, "<f8") - low) // width, 0, 2 ** bits - 1).astype(np.uint8).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("dim"), pa.array(data, pa.binary())], names=["id", "dim", "data"])

    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    file = classes.mapInArrow(cells, "id bigint, dim int, data binary")
    grid = (file.select("id", "dim", "data", F.lit(False).alias("ask"), own(blocks).alias("db"), every(ask_blocks).alias("qb"))
            .unionByName(asked.select(F.col("q").alias("id"), "dim", F.col("v").alias("data"), F.lit(True).alias("ask"), own(ask_blocks).alias("qb"), every(blocks).alias("db"))))
    bounds = grid.groupBy("qb", "db").applyInArrow(_scan(low, width, k + 1), "q bigint, c bigint, lower double, upper double")
    bounds = settle(bounds)
    floor = bounds.withColumn("_r", _best("q", [F.desc("lower"), F.col("c")], k + 1)).filter(F.col("_r") <= k + 1).groupBy("q").agg(F.when(F.count("*") > k, F.min("lower")).alias("floor"))
    left = bounds.join(floor, "q").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).withColumn("_r", _best("q", [F.desc("upper"), F.col("c")], k + 1))
    left = settle(left.select("q", "c", "upper", "_r"))

    def read(pairs: DataFrame) -> DataFrame:
        """(q, c, score) with the full vectors of just these pairs."""
        full = pairs.join(classes.select("c", "dim", F.col("v").alias("_cv")), "c").join(asked.select("q", F.col("v").alias("_qv")), "q").select("q", "c", "dim", "_qv", "_cv")

        def dots(batches):
            for batch in batches:
                dims, scores = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
                qv, cv = batch.column("_qv").to_pylist(), batch.column("_cv").to_pylist()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    a, b = (np.frombuffer(b"".join(x[i] for i in at), "<f8").reshape(len(at), dim) for x in (qv, cv))
                    scores[at] = _scores(a, b)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("c"), pa.array(scores)], names=["q", "c", "score"])

        return full.mapInArrow(dots, "q bigint, c bigint, score bigint")

    head = settle(read(left.filter(F.col("_r") <= k + 1)))
    sure = head.groupBy("q").agg(F.min("score").alias("sure"))
    more = read(left.filter(F.col("_r") > k + 1).join(sure, "q").filter(F.col("upper") >= F.col("sure")).select("q", "c"))
    best = head.unionByName(more).withColumn("_r", _best("q", [F.desc("score"), F.col("c")], k + 1)).filter(F.col("_r") <= k + 1)
    listed = best.join(members.select("c", "id"), "c").withColumn("_r", _best("q", [F.desc("score"), F.col("id")], k + 1)).filter(F.col("_r") <= k + 1).select("q", "id", "score")
    found = queries.join(listed, "q").filter("query_id <> id").withColumn("rank", _best("query_id", [F.desc("score"), F.col("id")], k)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
