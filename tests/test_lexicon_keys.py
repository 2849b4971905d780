"""Patterns and close words by the stored keys, against plain versions."""

import fnmatch
import random
import re

import pandas as pd
import pytest

from gleanery.functions import distance as D
from gleanery.functions import tokens as T
from gleanery.operators import clauses as C
from gleanery.operators.index import Field, SearchIndex

TERMS = ["a", "b", "ab", "ba", "aa", "abc", "cab", "bca", "banana", "ban", "bandana", "and", "andes", "hand", "handing", "singing", "sing", "king", "ingot", "tion", "nation", "national", "ration", "x.y", "x+y", "c++",
         "é", "éa", "aé", "漢字", "[x]", "a-b", "(q)", "$5", "tt", "ttt", "tat", "tot"]


@pytest.fixture(scope="module", params=["stored", "made"])
def idx(spark, request, tmp_path_factory):
    built = SearchIndex.build(spark.createDataFrame([(i, t) for i, t in enumerate(TERMS)], "doc_id long, t string"), [Field("t", T.tok_space)])
    return built.save(str(tmp_path_factory.mktemp("index"))) if request.param == "stored" else built


def terms_of(spark, expand, idx, patterns):
    clauses = spark.createDataFrame([(i, 0, "t", p) for i, p in enumerate(patterns)], "query_id long, clause_id int, field string, text string")
    out = {p: set() for p in patterns}
    rows = expand(idx, clauses).collect()
    for r in rows:
        out[patterns[r["query_id"]]].add(r["term"])
    assert len(rows) == sum(map(len, out.values()))
    return out


def test_prefixes(spark, idx):
    prefixes = ["a", "ba", "ban", "band", "", "zz", "漢", "é", "[", "singingg"]
    assert terms_of(spark, C.expand_prefix, idx, prefixes) == {p: {t for t in TERMS if t.startswith(p)} for p in prefixes}


def test_globs(spark, idx):
    globs = ["*ing", "?a*", "??", "*", "?", "*an*", "*a", "a*", "b*a", "*n*n*", "ban", "t[oa]t", "[ab]*", "[!ab]*", "?[an]*", "*é", "?é*", "**", "???*", "*x.y", "zzz*", "*zzz", "c++", "*+*", "?ngot", "(q)", "$*", "*tt*"]
    got = terms_of(spark, C.expand_wildcard, idx, globs)
    assert got == {g: {t for t in TERMS if fnmatch.fnmatchcase(t, g)} for g in globs}


def test_expressions(spark, idx):
    exprs = [".*tion", "ban", "b.n", "(an|ba)n?", "[a-c]+", "a*b", "ab?", "an{1,2}", "ba(na)+", "x\\.y", ".*ing$", "^an", "s?ing", "k?ing", ".", "..", "", "a|b", "\\w+ing", "(?:sing)+", ".+a.*", "t+", "h(a(n)d)", "c\\+\\+", ".*a$", "[^a].*n", "ba[n]", "n.*al", "(?i)BAN"]
    got = terms_of(spark, C.expand_regex, idx, exprs)
    assert got == {e: {t for t in TERMS if re.match(e, t)} for e in exprs}


def test_equal_clauses_are_looked_up_once_and_all_answered(spark, idx):
    rows = [(1, 0, "t", "*ing", 1.0), (1, 1, "t", "*ing", 2.0), (2, 0, "t", "*ing", 0.5)]
    hits = C.q_wildcard(idx, spark.createDataFrame(rows, "query_id long, clause_id int, field string, text string, boost double")).collect()
    docs = {i for i, t in enumerate(TERMS) if t.endswith("ing")}
    assert sorted((h["query_id"], h["clause_id"], h["doc_id"], h["score"]) for h in hits) == sorted((q, c, d, b) for q, c, _, _, b in rows for d in docs)


def osa(a, b):
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edited(r, word, times):
    b = list(word)
    for _ in range(times):
        k, kind = r.randrange(len(b) + 1), r.randrange(4)
        if kind == 0:
            b.insert(k, r.choice("abc"))
        elif kind == 1 and k < len(b):
            del b[k]
        elif kind == 2 and k < len(b):
            b[k] = r.choice("abc")
        elif k + 1 < len(b):
            b[k], b[k + 1] = b[k + 1], b[k]
    return "".join(b)


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_distances_side_by_side(limit):
    r = random.Random(limit)
    a = ["".join(r.choice("abcé漢\U0001F600") for _ in range(r.randrange(0, 9))) for _ in range(3000)]
    b = [edited(r, w, r.randrange(0, 5)) for w in a]
    assert D.osa_of_pairs(pd.Series(a), pd.Series(b), limit).tolist() == [min(osa(x, y), limit + 1) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("maxdist,prefix", [(1, 0), (2, 0), (2, 1), (3, 0)])
def test_close_words_of_all_lengths(spark, maxdist, prefix):
    r = random.Random(9)
    base = ["".join(r.choice("abcd") for _ in range(n)) for n in range(1, 41)]
    words = sorted({w for b in base for w in (b, edited(r, b, 1), edited(r, b, 2), edited(r, b, 3), b[:4][::-1] + b[4:]) if w})
    frame = spark.createDataFrame([("f", w) for w in words], "field string, text string")
    got = {(x["text"], x["term"], x["distance"]) for x in C.within_distance(frame, frame.withColumnRenamed("text", "term"), maxdist, prefix).collect()}
    assert got == {(x, y, osa(x, y)) for x in words for y in words if x[:prefix] == y[:prefix] and osa(x, y) <= maxdist}
