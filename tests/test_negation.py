"""Symbolic negation against listing every document."""

import random

from gleanery.operators import combine as H

DOCS, QUERIES = range(8), range(3)


def _hits(rng):
    return {(q, d): float(rng.randrange(1, 5)) for q in QUERIES for d in DOCS if rng.random() < 0.4}


def _plain_not(a, score=1.0):
    return {(q, d): score for q in QUERIES for d in DOCS if (q, d) not in a}


def _plain_or(parts, least=1):
    n = {k: sum(k in p for p in parts) for p in parts for k in p}
    return {k: sum(p.get(k, 0.0) for p in parts) for k in n if n[k] >= least}


def _plain_and(parts):
    return _plain_or(parts, len(parts))


def _plain_maybe(a, b):
    return {k: v + b.get(k, 0.0) for k, v in a.items()}


def test_trees(spark):
    rng = random.Random(4)
    a, b, c = (_hits(rng) for _ in range(3))
    A, B, C = (spark.createDataFrame([(q, d, s) for (q, d), s in x.items()], "query_id int, doc_id int, score double") for x in (a, b, c))
    doc_ids = spark.createDataFrame([(d,) for d in DOCS], "doc_id int")
    queries = spark.createDataFrame([(q,) for q in QUERIES], "query_id int")
    no, NO = _plain_not, H.negate
    cases = {
        "and": (H.h_and(A, NO(B)), _plain_and([a, no(b)]), False),
        "and of two": (H.h_and(A, NO(B), C, NO(C)), {}, False),
        "and of negations": (H.h_and(NO(A), NO(B)), _plain_and([no(a), no(b)]), True),
        "or": (H.h_or(A, NO(B)), _plain_or([a, no(b)]), True),
        "or of negations": (H.h_or(NO(A), NO(B)), _plain_or([no(a), no(b)]), True),
        "two of three": (H.h_or(A, NO(B), C, minmatch=2), _plain_or([a, no(b), c], 2), False),
        "one of three": (H.h_or(A, NO(B), NO(C), minmatch=2), _plain_or([a, no(b), no(c)], 2), True),
        "twice": (NO(NO(A)), {k: 1.0 for k in a}, False),
        "of an or": (NO(H.h_or(A, NO(B))), no(_plain_or([a, no(b)])), False),
        "and with an or": (H.h_and(C, H.h_or(A, NO(B))), _plain_and([c, _plain_or([a, no(b)])]), False),
        "and of ors": (H.h_and(H.h_or(A, NO(B)), H.h_or(C, NO(A))), _plain_and([_plain_or([a, no(b)]), _plain_or([c, no(a)])]), True),
        "maybe": (H.h_and_maybe(A, H.h_or(B, NO(C))), _plain_maybe(a, _plain_or([b, no(c)])), False),
        "maybe of negations": (H.h_and_maybe(NO(A), NO(B)), _plain_maybe(no(a), no(b)), True),
        "boolean": (H.h_boolean([A], [NO(B)], [C]), {k: v for k, v in _plain_maybe(a, no(b)).items() if k not in c}, False),
        "prohibited negation": (H.h_boolean([], [A, B], [NO(C)]), {k: v for k, v in _plain_or([a, b]).items() if k in c}, False),
        "required negation": (H.h_boolean([NO(A)], [B], [C]), {k: v for k, v in _plain_maybe(no(a), b).items() if k not in c}, True),
    }
    for name, (got, want, symbolic) in cases.items():
        assert isinstance(got, H.Negated) == symbolic, name
        rows = H.h_listed(doc_ids, got, queries).collect()
        assert len(rows) == len(want) and {(r.query_id, r.doc_id): r.score for r in rows} == want, name


def test_and_with_a_negation_is_one_anti_join(spark, capsys):
    a, b = (spark.createDataFrame([(1, 1, 1.0)], "query_id int, doc_id int, score double") for _ in range(2))
    H.h_and(a, H.negate(b)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Join") == 1 and plan.count("LeftAnti") == 1
