"""Merkle manifest of a dataset: one tree for each source under one tree of subroots, kept as postorder append logs.

Builders are aligned: each owns a block of 16 ** LEVELS consecutive nodes, closes LEVELS levels above them on its own and writes every
node the moment it is complete. The heads of all blocks are the leaves of the next tier of builders. A node's place in its log
follows from the sizes of the subtrees before it (``position``), so a proof reads its siblings by address and searches nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.arrays import indices, let
from gleanery.joins import lookup_join, wide_rank

from .common import only, quoted, settle

FAN_BITS = 4               # 16 children a node
LEVELS = 2                 # levels that one builder closes
BLOCK = 1 << (FAN_BITS * LEVELS)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A tree that holds more than one in HOT_SHARE of all nodes is hot when its size is joined.
HOT_SHARE = 50


def up(value, levels: int):
    """How many nodes stand ``levels`` levels above ``value`` nodes."""
    return F.shiftright(value + ((1 << (FAN_BITS * levels)) - 1), FAN_BITS * levels)


def position(level: int, index: Column, leaves: Column, depth: int) -> Column:
    """Place of node ``index`` of ``level`` in the postorder log of a tree of ``leaves`` leaves, of at most 16 ** ``depth``.

    Its last leaf ends everything below it. Before that leaf stand as many leaves as its number, and of each level as many nodes
    as were complete by then; after it come the nodes that it completes, one a level.
    """
    last = F.least(F.shiftleft(index + 1, FAN_BITS * level), leaves) - 1
    return sum((F.shiftright(last, FAN_BITS * k) for k in range(1, depth + 1)), last) + level


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes' count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(c) for c in columns]))


def _parents(nodes: Column) -> Column:
    return F.transform(indices(up(F.size(nodes), 1)), lambda j: digest(F.array_join(F.slice(nodes, F.shiftleft(j, FAN_BITS) + 1, 1 << FAN_BITS), "")))


def segments(nodes: DataFrame, sizes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The logs of one tier's builders: (tree, block, n, leaves, kids, height, log).

    ``nodes`` has (tree, index, digest, carry...), ``sizes`` (tree, n, leaves): the nodes of this tier and the leaves of the whole tree.
    ``log`` holds the digests in the order of completion. A group is one block, so it never has more than 256 rows.
    """
    block = F.shiftright("index", FAN_BITS * LEVELS)
    kids = F.sort_array(F.collect_list(F.struct("index", "digest", *carry)))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    packed = lookup_join(nodes.groupBy("tree", block.alias("block")).agg(kids.alias("kids")), sizes, ["tree"], hot=sizes.filter(F.col("n") * HOT_SHARE > total))
    # A tree of one block ends where one node is left; all blocks of a larger tree reach the same level.
    height = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        height = F.when(F.col("n") <= 1 << (FAN_BITS * level), F.lit(level)).otherwise(height)
    rows = packed.withColumn("height", height).withColumn("_l0", F.transform("kids", lambda k: k["digest"]))
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn(f"_l{level}", F.when(F.col("height") >= level, _parents(F.col(f"_l{level - 1}"))))

    def completed(leaf: Column, i: Column) -> Column:
        parts = [F.array(leaf)]
        for level in range(1, LEVELS + 1):
            size = 1 << (FAN_BITS * level)
            ends = (F.col("height") >= level) & ((i % size == size - 1) | (i == F.size("_l0") - 1))
            parts.append(F.when(ends, F.array(F.get(F.col(f"_l{level}"), F.shiftright(i, FAN_BITS * level)))).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    log = F.flatten(F.transform("_l0", completed))
    return rows.select("tree", "block", "n", "leaves", "kids", "height", log.alias("log"))


def build(nodes: DataFrame, carry: Sequence[str]) -> list[DataFrame]:
    """All tiers of a forest, lowest first, each settled; ``nodes`` has (tree, index, digest, carry...). A tier has 256 times fewer nodes
    than the one below it; the driver only learns whether one more is needed."""
    sizes = settle(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumn("leaves", F.col("n")))
    tiers = []
    while True:
        tier = settle(segments(nodes, sizes, carry))
        tiers.append(tier)
        tall = F.col("n") > BLOCK
        if sizes.filter(tall).isEmpty():
            return tiers
        nodes, carry = tier.filter(tall).select("tree", F.col("block").alias("index"), F.element_at("log", -1).alias("digest")), []
        sizes = sizes.filter(tall).select("tree", up(F.col("n"), LEVELS).alias("n"), "leaves")


def tops(tiers: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest): what remains of each tree; it ends the only segment of its last tier."""
    found = [t.filter(F.col("n") <= BLOCK).select("tree", F.element_at("log", -1).alias("digest")) for t in tiers]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _siblings(i: Column) -> Column:
    """Inside a segment: for leaf ``i`` and each level that was closed, the texts of the digests left and right of its ancestor."""
    count = F.size("kids")
    out = []
    for level in range(LEVELS):
        own = F.shiftright(i, FAN_BITS * level)
        first = own - own % (1 << FAN_BITS)
        stop = F.least(first + (1 << FAN_BITS), up(count, level))

        def run(start: Column, length: Column, level=level) -> Column:
            return F.array_join(F.transform(indices(length), lambda s: F.get("log", position(level, start + s, count, LEVELS - 1))), "")

        step = F.struct(run(first, own - first).alias("left"), run(own + 1, stop - own - 1).alias("right"))
        out.append(F.when(F.col("height") > level, F.array(step)).otherwise(F.array().cast("array<struct<left:string,right:string>>")))
    return F.concat(*out)


def prove(tiers: Sequence[DataFrame], crown: DataFrame | None = None) -> DataFrame:
    """(tree, index, digest, carry..., path, top, tree_top) for each leaf; ``path`` lists (left, right) texts of siblings up to ``top``.

    ``tree_top`` is what remains of the leaf's own tree. ``crown`` is (tree, path, top) of the tree above, whose leaves are the tops of
    this forest; without one ``top`` is ``tree_top``. Paths are handed down tier by tier: one row for each block, never one for each
    leaf, meets the tier above, by a key that each side holds once.
    """
    above = None
    for tier in reversed(tiers):
        alone = tier.filter(F.col("n") <= BLOCK)
        own = F.element_at("log", -1)
        if crown is None:
            head = alone.select("*", own.alias("tree_top"), own.alias("_top"), F.array().cast("array<struct<left:string,right:string>>").alias("_path"))
        else:
            head = alone.join(crown.select("tree", F.col("top").alias("_top"), F.col("path").alias("_path")), "tree").select(*alone.columns, own.alias("tree_top"), "_top", "_path")
        if above is not None:
            upper = above.select("tree", F.col("index").alias("block"), "tree_top", F.col("top").alias("_top"), F.col("path").alias("_path"))
            head = head.union(tier.filter(F.col("n") > BLOCK).join(upper, ["tree", "block"]).select(*head.columns))
        proved = F.transform("kids", lambda k, i: F.struct(k.alias("kid"), _siblings(i).alias("path")))
        above = head.select("tree", "tree_top", "_top", "_path", F.explode(proved).alias("_p")) \
            .select("tree", "_p.kid.*", F.concat("_p.path", "_path").alias("path"), F.col("_top").alias("top"), "tree_top")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The top that ``leaf`` leads to along the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def log_rows(tiers: Sequence[DataFrame]) -> DataFrame:
    """(tree, position, digest): the postorder log of each tree, a row for each node at its closed-form place."""
    def nodes(level: int) -> Column:
        count = F.size("kids")
        return F.transform(indices(up(count, level)), lambda s: F.struct(
            (s + F.shiftleft("block", FAN_BITS * (LEVELS - level))).alias("i"), F.get("log", position(level, s, count, LEVELS)).alias("digest")))

    out = None
    for t, tier in enumerate(tiers):
        # A tier's leaves were written by the tier below, as its heads.
        for level in range(1 if t else 0, LEVELS + 1):
            rows = tier.filter(F.col("height") >= level).select("tree", "leaves", F.explode(nodes(level)).alias("s"))
            # Blocks stand LEVELS * t levels above the leaves; 14 levels hold any number of rows.
            rows = rows.select("tree", position(level + LEVELS * t, F.col("s.i"), F.col("leaves"), 14).alias("position"), "s.digest")
            out = rows if out is None else out.union(rows)
    return out


def manifest(df: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None, fields: Sequence[str] = FIELDS,
             key: str = "doc_id", group: str = "source") -> DataFrame:
    """(key, leaf, subroot, root, path, changed, position) for each row: its digest, what remains of its source's tree and of the tree
    of subroots, the siblings on the way up, and its leaf's place in the log of its source.

    ``changed`` is the leaf with the columns in ``tampered`` replaced, where ``where`` holds (a null condition does not), else null.
    Leaves of a source ascend by key, nulls first; rows with the same key by their digests, so that repeated rows have
    equal leaves side by side. Null columns count as ``-``, an empty text as ``0:``; a null source is a source of its own, before all others. A source of
    one row has its leaf as subroot, and a table of one source its subroot as root. An empty table gives no rows. Texts never leave
    their row; other columns are not read. A source may hold any share of the rows: ranks come from ranges, trees from blocks.
    """
    names = list(dict.fromkeys([*fields, key, group]))
    rows = only(df, **{f"c{i}": n for i, n in enumerate(names)})
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    changed = F.lit(None).cast("string")
    if tampered:
        swap = {n: (tampered[n] if n in tampered else at[n]) for n in fields}
        changed = F.when(F.lit(True) if where is None else where, leaf_of([swap[n] for n in fields]))
    # Every name begins with a mark, so that null is a name as well and sorts before all others, bytewise.
    name = F.when(at[group].isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), at[group].cast("string")))
    # Settled, as ranging reads its input twice and texts are to be read and hashed once.
    leaves = settle(rows.select(name.alias("tree"), at[key].alias("key"), leaf_of([at[n] for n in fields]).alias("digest"), changed.alias("changed")))
    ranked = wide_rank(leaves, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest")], "rank")
    tiers = build(ranked.select("tree", (F.col("rank") - 1).alias("index"), "digest", "key", "changed"), ["key", "changed"])
    subroots = tops(tiers).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    above = build(wide_rank(subroots, ["tree"], [F.col("name")], "rank").select("tree", (F.col("rank") - 1).alias("index"), "digest", "name"), ["name"])
    crown = prove(above).select(F.col("name").alias("tree"), "path", "top")
    found = prove(tiers, crown)
    # The leaf's own place needs no size: no node above a leaf is complete before it is written.
    place = position(0, F.col("index"), F.col("index") + 1, 14)
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("tree_top").alias("subroot"), F.col("top").alias("root"), "path", "changed", place.alias("position"))


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``manifest`` with the digest of all siblings, the root that the changed (else the own) leaf leads to, and the verdict."""
    both = let(F.struct(F.col("path").alias("p")), lambda v: F.array_join(F.transform(v["p"], lambda s: F.concat(s["left"], s["right"])), ""))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return proofs.select(F.col(quoted(key)), "leaf", "subroot", "root", digest(both).alias("proof_sha256"), folded.alias("folded_root"), "position") \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
