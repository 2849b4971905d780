"""The manifest against a plain recursive tree, and its logs against a postorder walk."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gleanery.llm import merkle
from gleanery.llm.queries import op11_merkle_log


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    text = row["text"]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return H(*[told(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i: i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, place):
    for nodes in tree[:-1]:
        first = place - place % 16
        yield nodes[first: place], nodes[place + 1: first + 16]
        place //= 16


def postorder(tree):
    def walk(level, i):
        if level:
            for j in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
                yield from walk(level - 1, j)
        yield tree[level][i]

    return list(walk(len(tree) - 1, 0))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf(r, tampered)
            for a, b in path:
                node = H(*a, node, *b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], H(*[x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture(scope="module")
def table(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, path string, `index` long, c0 string"

    def build(sizes, extra=()):
        rows = [(100000 * k + 7 * i, s, "en" if i % 3 else None, i, f"Text {i} of {s}, É" if i % 4 else None, "x", "y", "z", 1, "w") for k, (s, n) in enumerate(sizes) for i in range(n)]
        return spark.createDataFrame(rows + list(extra), schema).repartition(5)

    return build


@pytest.mark.parametrize("sizes", [[("a", 1)], [("a", 16), ("b", 17), (None, 3)], [("a", 256), ("b", 257), ("", 1), ("é", 273)], [(f"s{i}", 1 + i % 3) for i in range(300)]])
def test_manifest_against_a_plain_tree(spark, table, tmp_path, sizes):
    odd = [(5, "a", None, None, "", "x", "y", "z", 1, "w"), (5, "a", None, None, "", "x", "y", "z", 1, "w"), (5, "a", "de", None, "A" * 200000, "x", "y", "z", 1, "w"), (None, None, None, None, None, "x", "y", "z", 1, "w")]
    for extra in ([], odd):
        df = table(sizes, extra)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = op11_merkle_log(spark, str(tmp_path)).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == plain([r.asDict() for r in df.collect()])


def test_three_tiers_of_builders(spark):
    """70,000 rows of one source and a few of another."""
    df = spark.range(70000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7000 == 3, F.lit("b")).otherwise(F.lit("a")).alias("source"), F.lit(None).cast("string").alias("lang"),
                                   F.col("id").alias("n_chars"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("text"))
    low = F.crc32(F.col("c0").cast("string").cast("binary")) % 5 == 0
    got = merkle.verify(merkle.manifest(df, {"text": F.lower("c4")}, low)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain([r.asDict() for r in df.collect()])
    # An unchanged row leads to the root; a changed one never does.
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0) for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4097])
def test_log_is_the_postorder_walk(spark, n):
    digests = [H(str(i)) for i in range(n)]
    nodes = spark.createDataFrame([("t", i, d) for i, d in enumerate(digests)], "tree string, `index` long, digest string")
    log = sorted((r["position"], r["digest"]) for r in merkle.log_rows(merkle.build(nodes, [])).collect())
    walk = postorder(levels(digests))
    assert [p for p, _ in log] == list(range(len(walk)))
    assert [d for _, d in log] == walk


def test_empty_table_and_single_null_row(spark, table):
    assert merkle.verify(merkle.manifest(table([]))).count() == 0
    only = merkle.verify(merkle.manifest(table([], [(None,) * 10]))).first()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] == H("-----") and only["verified"]
    assert only["proof_sha256"] == H()
