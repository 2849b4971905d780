"""Brute force and algebra on small made corpora, and the paths taken when nothing fits a broadcast."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleanery import joins
from gleanery.functions import tokens as T
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import facets as Fa
from gleanery.operators import mining as M
from gleanery.operators import ranking as Rk
from gleanery.operators.index import SearchIndex, text_field


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not (i and j)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    vocabulary = ["common"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(["common"] * (i % 3) + rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(120)]
    rows += [(200 + i, "the same copied text again w1 w2") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def index(corpus):
    return SearchIndex.build(corpus, [text_field("text")])


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(q, i, "text", w, 1.0) for q, ws in ((1, ["common", "w1"]), (2, ["w2", "w3", "common"])) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "query_id int, clause_id int, field string, term string, boost double")


def pairs(df):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}


def test_algebra(index, terms):
    hits = C.match(index, H.clause_counts(terms))
    both, any_ = pairs(H.all_of(hits)), pairs(H.any_of(hits))
    assert both and set(both) <= set(any_)
    a, b = (hits.filter(F.col("clause_id") == i).select("query_id", "doc_id", "score") for i in (0, 1))
    assert set(pairs(H.h_and_not(a, b))) | set(pairs(H.h_require(a, b))) == set(pairs(a))
    whole = {(r.query_id, r["rank"]): r.doc_id for r in Rk.rank_all(H.any_of(hits)).collect()}
    best = {(r.query_id, r["rank"]): r.doc_id for r in Rk.top_k(H.any_of(hits), 5).collect()}
    assert all(whole[k] == v for k, v in best.items()) and len(best) == 10


def test_shuffled_paths_agree(index, terms, monkeypatch):
    small = pairs(H.any_of(C.match(index, terms)))
    monkeypatch.setattr(C, "measured", lambda *a, **k: (False, {"buckets": None}))
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    assert pairs(H.any_of(C.match(index, terms))) == small


def test_more_like_with_copies(index, corpus):
    rows = M.more_like(index, "text", top=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r["rank"], r.like_id))
    assert all(d not in [x for _, x in v] for d, v in by.items())
    copies = [v for d, v in by.items() if d >= 200]
    assert len(copies) == 60 and all(len(v) == 3 and all(x >= 200 for _, x in v) for v in copies)


def test_within_distance(spark):
    rnd = random.Random(3)
    ws = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(60)]
    long = "".join(rnd.choices("abcdefgh", k=30))
    ws += [long, long[1:], long[:10] + "zz" + long[10:], long[:5] + long[6] + long[5] + long[7:], long[:15] + "q" + long[17:]]
    ws = sorted(set(ws))
    w = spark.createDataFrame([("f", x) for x in ws], "field string, text string")
    for k, p in ((1, 1), (2, 0)):
        got = {(r.text, r.term, r.distance) for r in C.within_distance(w, w.withColumnRenamed("text", "term"), k, p).collect()}
        want = {(a, b, osa(a, b)) for a in ws for b in ws if a[:p] == b[:p] and osa(a, b) <= k}
        assert got == want


def test_near_duplicates_cover_all_pairs(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(32) for _ in range(6)]
    hs = [(i, base[i % 6] ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32))) for i in range(60)] + [(100 + i, base[0]) for i in range(40)]
    links = M.near_duplicates(spark.createDataFrame(hs, "doc_id long, simhash long"), 3).collect()
    value = dict(hs)
    rep = {d: min(x for x, h in hs if h == v) for d, v in hs}
    linked = {frozenset((r.doc_a, r.doc_b)) for r in links}
    for (a, ha), (b, hb) in itertools.combinations(hs, 2):
        near = bin(ha ^ hb).count("1") <= 3
        assert near == (rep[a] == rep[b] or frozenset((rep[a], rep[b])) in linked)
    assert all(bin(value[r.doc_a] ^ value[r.doc_b]).count("1") == r.distance for r in links)


def test_wide_rank_of_one_big_group(spark):
    df = spark.range(5000).selectExpr("'g' AS g", "(id * 7919) % 5003 AS v")
    rows = joins.wide_rank(df, ["g"], [F.col("v").asc()]).orderBy("v").collect()
    assert [r["rank"] for r in rows] == list(range(1, 5001))


@pytest.mark.parametrize("broadcast", [True, False])
def test_range_join(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    rnd = random.Random(2)
    points = [(i, x) for i, x in enumerate([0.0, 0.0, 1e-9, 1e9, None, *(rnd.uniform(-5, 700) for _ in range(300)), *(float(rnd.randrange(0, 600)) for _ in range(100))])]
    ranges = [(i, i * 3.0, i * 3.0 + 5) for i in range(60)] + [(99, None, 4.0), (100, 650.0, None), (101, None, None), (102, 5.0, 4.0), (103, -1e12, 1e12), (104, 2e9, 3e9), (105, 7.0, 7.0), (106, 0.0, 0.0)]
    ranges += [(200 + i, a, a + rnd.choice([0.1, 1, 30, 400])) for i, a in enumerate(rnd.uniform(-10, 700) for _ in range(80))]
    p, r = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, lo double, hi double")
    cond = (F.col("lo").isNull() | (F.col("x") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") <= F.col("hi")))
    got = [(z.p, z.r) for z in joins.range_join(p, "x", r, "lo", "hi", cond).collect()]
    want = {(i, k) for i, x in points if x is not None for k, lo, hi in ranges if (lo is None or x >= lo) and (hi is None or x <= hi)}
    assert len(got) == len(set(got)) and set(got) == want
    assert joins.range_join(p.filter("p < 0"), "x", r, "lo", "hi", cond).count() == 0 and joins.range_join(p, "x", r.filter("r < 0"), "lo", "hi", cond).count() == 0


def test_cells_cover_a_range_once(spark):
    rnd = random.Random(8)
    pairs = [(0, 16 ** 6 - 1), (0, 0), (15, 16), (16, 31), (1, 16 ** 5), (17, 16 ** 6 - 2)] + [tuple(sorted((rnd.randrange(16 ** 6), rnd.randrange(16 ** 6)))) for _ in range(100)] + [(a, a + rnd.randrange(300)) for a in range(0, 5000, 37)]
    for a, b, cells in spark.createDataFrame(pairs, "a long, b long").select("a", "b", joins._cells_of(F.col("a"), F.col("b"))).collect():
        parts = sorted((n * 16 ** k, (n + 1) * 16 ** k - 1) for k, n in cells)
        assert parts[0][0] == a and parts[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(cells) <= 30 * 6 + 1


def test_facet_ranges_and_uneven_months(spark):
    rows = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, 1, 5.9, 6, 15, 16, 25.9, 26, 44, 45, 46, 55, 56)], "v double")
    for gaps in ([1, 5, 10], [10], [30, 30, 30], [100]):
        for hard in (False, True):
            spans = Fa.range_buckets(0, 45, gaps, hard)
            for r in Fa.facet_range(rows, "v", 0, 45, gaps, hard).collect():
                assert (r["lo"], r["hi"]) == next(((a, b) for a, b in spans if a <= r["v"] < b), (None, None))
    days = spark.sql("SELECT explode(sequence(timestamp_ntz'2023-12-30', timestamp_ntz'2024-04-02', interval 6 hours)) AS t")
    got = Fa.facet_date_range(days, "t", "2024-01-01", "2024-04-01", "1 month").groupBy("lo", "hi").count().orderBy("lo").collect()
    assert [(str(r["lo"])[:10], str(r["hi"])[:10], r["count"]) for r in got] == [("2024-01-01", "2024-02-01", 124), ("2024-02-01", "2024-03-01", 116), ("2024-03-01", "2024-04-01", 124)]
    plan = Fa.facet_date_range(days, "t", "2024-01-01", "2024-04-01", "1 month")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


