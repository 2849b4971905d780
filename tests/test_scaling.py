"""Index tables on use, hits grouped where their documents lie, complements without pairs: results against plain Python, and the plans."""

import glob

import pytest
from pyspark.sql import functions as F

from gleanery.functions.scoring import frequency
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import lexicon as L
from gleanery.operators import positional as P
from gleanery.operators import ranking as Rk
from gleanery.operators.groups import q_multitoken
from gleanery.operators.index import IndexOnUse, doc_counts, text_field

TEXTS = [(1, "red green blue"), (2, "green grey red red"), (3, None), (4, "blue brown"), (4, "blue brown"), (None, "green grey")]


@pytest.fixture
def idx(spark, tmp_path):
    return IndexOnUse(spark.createDataFrame(TEXTS, "doc_id long, text string"), [text_field("text")], str(tmp_path))


def terms(spark, rows):
    return spark.createDataFrame(rows, "query_id long, clause_id int, term string").withColumn("field", F.lit("text")).withColumn("boost", F.lit(1.0))


def exchanges_above_documents(df):
    """Shuffles of rows that have both a query and a document."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "query_id" in x and "doc_id" in x]


def test_tables_are_written_when_first_read(idx, tmp_path):
    assert doc_counts(idx).first()["doc_count"] == 6
    assert glob.glob(f"{tmp_path}/*") == []
    assert {r["term"] for r in idx.lexicon.collect()} == {"red", "green", "blue", "grey", "brown"}
    assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/*")} == {"forward", "term_stats"}


def test_hits_are_grouped_without_a_shuffle(spark, idx):
    t = terms(spark, [(1, 0, "red"), (1, 1, "green"), (2, 0, "blue"), (2, 1, "red")])
    hits = H.any_of(C.match(idx, t, frequency, together=True))
    assert sorted(map(tuple, hits.select("query_id", "doc_id", "score").collect()), key=str) == sorted(
        [(1, 1, 2.0), (1, 2, 3.0), (1, None, 1.0), (2, 1, 2.0), (2, 2, 2.0), (2, 4, 2.0)], key=str)
    assert not exchanges_above_documents(hits)


def test_spans_meet_without_a_shuffle_and_repeated_ids_as_in_a_join(spark, idx):
    a, b = (P.term_spans(idx, terms(spark, [(1, 0, w)]), frequency).select(*P.COLUMNS) for w in ("blue", "brown"))
    near = P.s_near(a, b, slop=2)
    assert [(r["doc_id"], r["score"], [tuple(s) for s in r["spans"]]) for r in near.collect()] == [(4, 2.0, [(0, 1)])] * 4
    assert not exchanges_above_documents(near)
    g, r = (P.term_spans(idx, terms(spark, [(1, 0, w)]), frequency).select(*P.COLUMNS) for w in ("green", "grey"))
    left = {(x["doc_id"], len(x["spans"])) for x in P.s_not(g, r).collect()}
    assert left == {(1, 1), (2, 1), (None, 1)}
    assert {x["doc_id"] for x in P.s_near(g, r).collect()} == {2}


def test_complement_makes_no_pairs(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    hits = spark.createDataFrame([(7, 1, 1.0), (7, None, 1.0), (None, 2, 1.0), (8, 2, 1.0)], "query_id long, doc_id long, score double")
    queries = spark.createDataFrame([(7,), (8,), (None,)], "query_id long")
    out = H.h_not(docs, hits, queries)
    expected = [(q, d) for q in (7, 8, None) for d in (1, 2, 2, None) if (q, d) not in {(7, 1), (8, 2)}]
    assert sorted([(r["query_id"], r["doc_id"]) for r in out.collect()], key=str) == sorted(expected, key=str)
    assert not exchanges_above_documents(out.filter("query_id > 0"))


def test_upgrade_extend_is_both_steps(spark):
    ranked = "query_id long, doc_id long, score double, rank int"
    a = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3)], ranked)
    b = spark.createDataFrame([(1, 9, 5.0, 1), (1, 3, 4.0, 2), (2, 1, 1.0, 1)], ranked)
    both = Rk.r_extend(Rk.r_upgrade(a, b), b)
    assert sorted(map(tuple, Rk.r_upgrade_extend(a, b).collect())) == sorted(map(tuple, both.collect()))


def test_ranges_asked_twice_are_looked_up_once(spark, idx):
    rows = [(1, 0, "text", "b", None), (2, 0, "text", "b", None), (2, 1, "text", "r", "rz")]
    clauses = spark.createDataFrame(rows, "query_id long, clause_id int, field string, start string, end string") \
        .withColumn("startexcl", F.lit(False)).withColumn("endexcl", F.lit(False))
    found = {(r["query_id"], r["clause_id"], r["doc_id"]) for r in C.q_term_range(idx, clauses).collect()}
    every = {(q, 0, d) for q in (1, 2) for d in (1, 2, 4, None)}
    assert found == every | {(2, 1, 1), (2, 1, 2)}


MULTI = {"first": [(1, 1.0), (2, 2.0)], "and": [(1, 2.0), (2, 3.0)], "or": [(1, 2.0), (2, 3.0), (None, 1.0)]}


@pytest.mark.parametrize("rule", MULTI)
def test_words_of_several_tokens_meet_without_a_shuffle(spark, idx, rule):
    words = spark.createDataFrame([(1, 0, "text", ["red", "green"], rule, 1.0)], "query_id long, clause_id int, field string, words array<string>, rule string, boost double")
    found = q_multitoken(idx, words, model=frequency).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    assert sorted(((r["doc_id"], r["score"]) for r in found.collect()), key=str) == sorted(MULTI[rule], key=str)
    assert not exchanges_above_documents(found)


def test_hits_decide_the_tasks_and_not_the_postings(spark, idx, monkeypatch):
    t = terms(spark, [(q, 0, "red") for q in range(100)])
    assert C.hit_tasks(idx, t) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(C, "TASK_HITS", 10)
    df = idx.term_stats.filter("term = 'red'").first()["df"]
    assert C.hit_tasks(idx, t) == 10 * df > spark.sparkContext.defaultParallelism
    assert C.match(idx, t, frequency, together=True, tasks=37).rdd.getNumPartitions() == 37


def test_pieces_decide_the_tasks_of_compounds(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_PIECES", 10)
    lexicon = spark.createDataFrame([("greeneggs",), ("green",), ("greeneggs",), ("",), (None,), ("hams",)], "term string")
    words = spark.createDataFrame([("green",), ("eggs",), ("gre",), ("ham",), ("enegg",)], "term string")
    out = L.f_compound(lexicon, words)
    assert sorted((r["term"], r["part_no"], r["part"]) for r in out.collect()) == [("greeneggs", 0, "greeneggs"), ("greeneggs", 1, "green"), ("greeneggs", 2, "eggs")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # 9 letters twice, 5, and 4, each by the longest word's 5.
    assert "RepartitionByExpression [term" in plan and ", 14\n" in plan
    assert sum(line.count("aggregate(") > 0 for line in plan.split("\n")) == 1
