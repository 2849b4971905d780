"""Phrases and words of several tokens against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleanery import joins
from gleanery.functions import tokens as T
from gleanery.functions.scoring import frequency
from gleanery.operators import phrases as Ph
from gleanery.operators.groups import q_multitoken, word_tokens
from gleanery.operators.index import Field, SearchIndex


def index_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    return SearchIndex.build(df, [Field("t", T.tok_space)])


def plain(words, text, slop):
    held = text.split()
    spans = {(p, p) for p, w in enumerate(held) if w == words[0]}
    for word in words[1:]:
        spans = {(s, p) for s, e in spans for p in range(e + 1, min(e + slop, len(held) - 1) + 1) if held[p] == word}
    return sorted(spans)


@pytest.mark.parametrize("bits", [Ph.BLOCK_BITS, 3])
def test_phrases_against_a_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(Ph, "BLOCK_BITS", bits)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randrange(1, 40))) for _ in range(60)] + ["", "a", "a a a a a", "a b " * 30]
    asked = [[r.choice("abcdef") for _ in range(r.randrange(1, 7))] for _ in range(60)] + [["a", "a", "a"], ["a", "zz"], ["zz"], [], ["b"]]
    rows = [(i, "t", w, 1 + i % 4) for i, w in enumerate(asked)] + [(500, "t", ["a", "b"], 2), (501, "t", ["a", "b"], 2)]
    queries = spark.createDataFrame(rows, "query_id long, field string, words array<string>, slop int")
    got = {(h["query_id"], h["doc_id"]): (h["score"], [tuple(s) for s in h["spans"]]) for h in Ph.s_phrase(index_of(spark, texts), queries, frequency).collect()}
    want = {}
    for (i, _, words, slop), (d, text) in itertools.product(rows, enumerate(texts)):
        spans = plain(words, text, slop) if words else []
        if spans:
            want[i, d] = (float(sum(text.split().count(w) for w in words)), spans)
    assert got == want


def test_a_long_text_of_two_words_is_linear(spark):
    idx = index_of(spark, ["x y " * 20000, "y x"])
    queries = spark.createDataFrame([(0, "t", ["x", "y", "x", "y"], 3), (1, "t", ["y", "x"], 1)], "query_id long, field string, words array<string>, slop int")
    found = {(h["query_id"], h["doc_id"]): h["spans"] for h in Ph.s_phrase(idx, queries, frequency).collect()}
    # x at every even place, three steps of 1 or 3 to the places after it: ends 3, 5, 7 or 9 further, while the text lasts.
    assert len(found[0, 0]) == sum(sum(2 * k + d < 40000 for d in (3, 5, 7, 9)) for k in range(20000))
    assert len(found[1, 0]) == 19999 and len(found[1, 1]) == 1


def test_boosts_and_equal_phrases(spark):
    idx = index_of(spark, ["a b", "b a"])
    queries = spark.createDataFrame([(0, "t", ["a", "b"], 1.0), (1, "t", ["a", "b"], 2.5)], "query_id long, field string, words array<string>, boost double")
    assert sorted((h["query_id"], h["doc_id"], h["score"]) for h in Ph.s_phrase(idx, queries, frequency).collect()) == [(0, 0, 2.0), (1, 0, 5.0)]


RULES = {"first": {0, 1, 2, 3}, "and": {0, 1}, "or": {0, 1, 2, 3, 4}, "phrase": {0}}


@pytest.mark.parametrize("rule", RULES)
def test_words_of_several_tokens(spark, rule):
    idx = index_of(spark, ["a b", "b a", "a", "a c", "b", "c"])
    queries = spark.createDataFrame([(7, "a-b c")], "query_id long, text string")
    words = word_tokens(queries, lambda c: T.tok_regex(c, "[a-z]"), "t", rule)
    hits = q_multitoken(idx, words, model=frequency).collect()
    assert {h["doc_id"] for h in hits if h["clause_id"] == 0} == RULES[rule]
    assert {h["doc_id"] for h in hits if h["clause_id"] == 1} == {3, 5}


def test_default_follows_the_group_and_rules_mix(spark):
    idx = index_of(spark, ["a b", "a", "b b"])
    tokens = spark.createDataFrame([(1, 0, "t", ["a", "b"], "default", 1.0), (1, 1, "t", ["b", "b"], "or", 1.0), (1, 2, "t", ["b", "b"], "phrase", 1.0)],
                                   "query_id long, clause_id int, field string, words array<string>, rule string, boost double")
    told = lambda group: sorted((h["clause_id"], h["doc_id"], h["score"]) for h in q_multitoken(idx, tokens, group, frequency).collect())
    rest = [(1, 0, 2.0), (1, 2, 4.0), (2, 2, 4.0)]
    assert told("and") == [(0, 0, 2.0), *rest]
    assert told("or") == [(0, 0, 2.0), (0, 1, 1.0), (0, 2, 2.0), *rest]


def test_measured_counts_what_arrays_hold(spark):
    df = spark.createDataFrame([([["x" * 1000] * 50], {"k": [1.0] * 100})], "a array<array<string>>, m map<string,array<double>>")
    assert joins.fits_broadcast(df, max_bytes=60_000) and not joins.fits_broadcast(df, max_bytes=50_000)
    assert joins.fits_broadcast(spark.createDataFrame([(None, None)], "a array<string>, m map<string,int>"), max_bytes=1000)
    assert joins.fits_broadcast(df.select(F.lit(None).cast("struct<x:string,y:array<int>>").alias("odd name")))
