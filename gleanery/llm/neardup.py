"""Near-duplicate documents by MinHash with tensored banding: table keys are pairs from two small collections of half keys.

``width`` half keys on either side give ``width ** 2`` tables for the price of ``2 * width * rows`` minhashes. Two documents
of similarity s meet in some table with a chance of (1 - (1 - s ** rows) ** width) ** 2: 0.9996 at 0.8, over 0.99999 at 0.85
with the defaults. Candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, mix, only, quoted, settle, steps, strings

WIDTH, ROWS = 12, 3
# Longs of a set's parity bits: where two sets differ in d bits, their symmetric difference has d members or more.
PARITY = 16


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the distinct ``size``-word shingles of each text in order of row and hash. Words are lower-cased (A-Z);
    fewer words are one shingle; a text without words has none."""
    words = Words(texts, lower=True)
    word_hash = np.array([xxhash.xxh64_intdigest(w) for w in words.names.cast(pa.binary()).to_pylist()], np.uint64) if len(words.names) else np.empty(0, np.uint64)
    h = word_hash[words.code] if len(words.code) else np.empty(0, np.uint64)
    n = len(h)
    start = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1:]) if n >= size else np.empty(0, np.int64)
    value = np.zeros(len(start), np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[start + k] + np.uint64(k + 1))
    row = words.row[start]
    for r in np.flatnonzero((words.count > 0) & (words.count < size)):
        v = np.zeros(1, np.uint64)
        for k, x in enumerate(h[words.first[r]: words.first[r + 1]]):
            v = mix(v * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(k + 1))
        row, value = np.append(row, r), np.append(value, mix(v + np.uint64(words.count[r])))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)


def sketches(df: DataFrame, key: str, text: str, size: int, width: int, rows: int) -> DataFrame:
    """(_id, n, set_a, set_b, left, right, o0...): the size of each row's shingle set, 128 bits that name the set, its half keys, its parity bits."""
    picked = only(df, _id=key, _x=text)
    kind = picked.schema["_id"].dataType.simpleString()
    seeds = mix(np.arange(1, 2 * width * rows + 1, dtype=np.uint64))

    def run(batches):
        for batch in steps(batches, "_x"):
            row, value = shingle_hashes(strings(batch.column("_x")), size)
            at, total = _starts(row), batch.num_rows
            count = np.bincount(row, minlength=total).astype(np.int64)
            some = row[at] if len(row) else np.empty(0, np.int64)
            sums = np.zeros((2, total), np.uint64)
            half = np.zeros((2 * width, total), np.uint64)
            if len(at):
                sums[0, some] = np.add.reduceat(mix(value), at)
                sums[1, some] = np.add.reduceat(mix(value + np.uint64(0xA0761D6478BD642F)), at)
                for j in range(2 * width):
                    acc = np.full(len(at), j + 1, np.uint64)
                    for i in range(rows):
                        seed = seeds[j * rows + i]
                        low = np.minimum.reduceat((value ^ seed) * (seed | np.uint64(1)) ^ (value >> np.uint64(29)), at)
                        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low)
                    half[j, some] = acc
            bit = (mix(value ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(54)).astype(np.int64)
            odd = (np.bincount(row * 1024 + bit, minlength=total * 1024) & 1).astype(np.uint8).reshape(total, 1024)
            parity = np.ascontiguousarray(np.packbits(odd, axis=1).view(np.int64).T)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(h.T).reshape(-1).view(np.int64)), width).cast(pa.list_(pa.int64())) for h in (half[:width], half[width:])]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(count), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *lists, *map(pa.array, parity)],
                                             names=["_id", "n", "set_a", "set_b", "left", "right", *(f"o{i}" for i in range(PARITY))])

    return picked.mapInArrow(run, f"_id {kind}, n bigint, set_a bigint, set_b bigint, left array<bigint>, right array<bigint>, " + ", ".join(f"o{i} bigint" for i in range(PARITY)))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) whose full shingle sets reach ``percent``. Both texts meet in one row, so each pair is settled alone."""
    a, b = texts.select(F.col("_id").alias("a"), F.col("_x").alias("_ta")), texts.select(F.col("_id").alias("b"), F.col("_x").alias("_tb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in steps(iter([whole]), "_ta", 2 << 20):
                texts = pa.concat_arrays([strings(batch.column("_ta")), strings(batch.column("_tb"))])
                row, value = shingle_hashes(texts, size)
                m = batch.num_rows
                n = np.bincount(row, minlength=2 * m)
                order = np.lexsort((value, row % m))
                pair, value = row[order] % m, value[order]
                twice = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(pair[1:][twice], minlength=m)
                good = 100 * common >= percent * (n[:m] + n[m:] - common)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


# Links to a task of the component rounds: they are few columns wide, and fewer tasks than rows allow leave fewer files.
LINKS_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the (a, b) links the smallest node it reaches. Large-star and small-star rounds until
    nothing changes; each round keeps at most one link for each node and neighbour, and is settled. The tasks follow the number of
    links, which a sum over them tells."""
    def held(links: DataFrame) -> tuple[DataFrame, tuple]:
        links = settle(links)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        return links.coalesce(1 + state[0] // LINKS_PER_TASK), state

    links, state = held(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct())
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))       # u sees v
        both = both.coalesce(1 + 2 * state[0] // LINKS_PER_TASK)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        links, new = held(small)
        if new == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = 80, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row.

    Texts with equal shingle sets are one class and only its smallest key goes on. Where a table's bucket holds several classes,
    each is first held against a few others: the one with the least hash, and the one before it in the order of another half key.
    What stays outside the bucket's largest component is then held against a member of that. So a large group of near copies makes
    pairs in proportion to its size. What these links leave apart is compared in full, bucket by bucket, all but the
    largest component against everything, as one more link there may still join two components. Before the texts of a pair
    are read, its sizes and parity bits must allow the similarity.

    Null, empty and blank texts have no shingles and stay alone; rows that repeat a key are one node; rows with a null key are
    nodes without links; an empty table gives an empty result. Sets are compared by 64-bit shingle hashes.
    """
    rows_in = settle(sketches(df, key, text, size, width, rows))
    full = rows_in.filter("n > 0 AND _id IS NOT NULL")
    reps = full.groupBy("set_a", "set_b").agg(F.min("_id").alias("rep"))
    heads = settle(full.join(reps.select(F.col("rep").alias("_id"), "set_a", "set_b"), ["_id", "set_a", "set_b"]).dropDuplicates(["_id"]))
    # The neighbour before a class is looked up in one table of each left half key: the others order nearly the same classes.
    tables = F.explode(F.flatten(F.transform("left", lambda x, i: F.transform(F.col("right"), lambda y, j: F.struct(
        F.xxhash64(x, y, i, j).alias("bucket"), F.when(i == j, F.get(F.col("left"), (i + 1) % width)).alias("near"))))))
    keyed = heads.select("_id", tables.alias("t")).select("_id", "t.*")
    whole, along = Window.partitionBy("bucket"), Window.partitionBy("bucket").orderBy("near", "_id")
    buckets = settle(keyed.select("bucket", "_id", F.count("*").over(whole).alias("_c"), F.min(F.struct(F.xxhash64("_id"), F.col("_id"))).over(whole)["_id"].alias("star"), F.when(F.col("near").isNotNull(), F.lag("_id").over(along)).alias("prev"))
                     .filter("_c > 1").drop("_c"))
    bits = heads.select("_id", "n", *[f"o{i}" for i in range(PARITY)])

    def named(prefix: str) -> DataFrame:
        return bits.select(*[F.col(c).alias(prefix + c) for c in bits.columns])

    def possible(a: str, b: str):
        """Sizes and parity bits allow the similarity: an exact test that drops only pairs below it."""
        apart = sum((F.bit_count(F.col(f"{a}o{i}").bitwiseXOR(F.col(f"{b}o{i}"))) for i in range(PARITY)), F.lit(0))
        total = F.col(f"{a}n") + F.col(f"{b}n")
        return (100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")) & ((100 + percent) * apart <= (100 - percent) * total)

    every_text = only(df, _id=key, _x=text)

    def confirmed(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        return settle(_confirmed(pairs, every_text.join(used, "_id", "left_semi").dropDuplicates(["_id"]), size, percent))

    def worth(pairs: DataFrame) -> DataFrame:
        """Distinct (a, b) of (_id, other) that sizes and parity bits allow."""
        pairs = pairs.filter("_id <> other").select(F.least("_id", "other").alias("a"), F.greatest("_id", "other").alias("b")).distinct()
        return pairs.join(named("a_").withColumnRenamed("a__id", "a"), "a").join(named("b_").withColumnRenamed("b__id", "b"), "b").filter(possible("a_", "b_")).select("a", "b")

    def still_open(roots: DataFrame) -> DataFrame:
        """(bucket, _id, root, main) of the buckets that hold several components; ``main`` is the largest one there."""
        rooted = buckets.select("bucket", "_id").join(roots.withColumnRenamed("node", "_id"), "_id", "left").select("bucket", "_id", F.coalesce("root", "_id").alias("root"))
        main = rooted.groupBy("bucket", "root").count().groupBy("bucket").agg(F.count("*").alias("_k"), F.max_by("root", F.struct("count", "root")).alias("main")).filter("_k > 1").drop("_k")
        return settle(rooted.join(main, "bucket"))

    tried = settle(worth(buckets.select("_id", F.explode(F.array("star", "prev")).alias("other")).filter("other IS NOT NULL")))
    links = confirmed(tried)
    apart = still_open(settle(components(links)))
    stars = apart.filter("root = main").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "_id"), F.col("_id")))["_id"].alias("other"))
    again = settle(worth(apart.filter("root <> main").join(stars, "bucket").select("_id", "other")).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(confirmed(again))
    roots = settle(components(links))
    apart = still_open(roots)
    a_side = apart.filter("root <> main").select("bucket", F.col("_id").alias("a__id"), F.col("root").alias("a_root"), "main").join(named("a_"), "a__id")
    b_side = apart.select("bucket", F.col("_id").alias("b__id"), F.col("root").alias("b_root")).join(named("b_"), "b__id")
    once = (F.col("b_root") == F.col("main")) | (F.col("a__id") < F.col("b__id"))
    rest = a_side.join(b_side, "bucket").filter((F.col("a_root") != F.col("b_root")) & once & possible("a_", "b_")).select(F.least("a__id", "b__id").alias("a"), F.greatest("a__id", "b__id").alias("b"))
    rest = settle(rest.distinct().join(tried.unionByName(again), ["a", "b"], "left_anti"))
    last = confirmed(rest)
    if not last.isEmpty():
        roots = components(links.unionByName(last))
    of_set = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("_root"))
    out = rows_in.join(of_set, ["set_a", "set_b"], "left")
    alone = (F.col("n") == 0) | F.col("_id").isNull()
    root = F.when(alone, F.col("_id")).otherwise(F.col("_root"))
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("_id") == root, F.lit(True)).alias("kept"))
