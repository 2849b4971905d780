"""Queries with many hits: tasks that follow the hits, plans that sort and shuffle no hit, results against plain Python."""

import time

import pytest
from pyspark.sql import functions as F

import checks.registry as R
from gleanery.functions import spans as S
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import positional as P
from gleanery.session import stored

DOCUMENTS = [(1, "red green blue", "en", "a"), (2, "green grey red red", "fr", "a"), (3, None, "en", "b"), (4, "blue brown", "en", "b"), (4, "blue brown", "en", "b"), (None, "green grey", "en", None)]
BENCHMARK = [(0, "red green blue"), (1, "green grey grown"), (2, "blue brown")]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["h_dismax_fields", "h_multifield"])
def test_hits_decide_the_tasks_of_queries_over_fields(spark, tables, monkeypatch, name):
    monkeypatch.setattr(C, "TASK_HITS", 1)
    found = plan(R.QUERIES[name](spark, tables))
    assert "REPARTITION_BY_NUM" in found and "REPARTITION_BY_COL" not in found
    assert "SortAggregate" not in found


def test_roles_are_hashed_and_keep_their_order(spark):
    rows = [(1, d, c, s, role, 1) for d, c, s, role in (
        (1, 0, 1.0, "+"), (1, 1, 2.0, ""), (2, 0, 1.0, "+"), (2, 1, 2.0, "-"), (3, 1, 2.0, ""), (4, 0, 1.0, "+"), (4, 1, 2.0, None),
        # The last of a word's roles holds: "-" comes after "+", other words after both.
        (5, 0, 1.0, "+"), (5, 0, 1.0, "-"), (6, 0, 1.0, "+"), (6, 1, 1.0, "-"), (6, 1, 3.0, "x"), (7, 0, 1.0, "+"), (7, 1, 1.0, ","), (7, 1, 1.0, "+"))]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, clause_id int, score double, role string, n_required int")
    out = H.h_dismax_fields(hits)
    assert sorted((r["doc_id"], r["score"]) for r in out.collect()) == [(1, 3.0), (4, 1.0), (6, 4.0), (7, 2.0)]
    assert "SortAggregate" not in plan(out)


def spans_of(rows, n):
    """All lists of ``n`` spans out of ``rows`` numbers, in a made order."""
    return [[(7 * (i + k) % 13, 7 * (i + k) % 13 + (3 * i + 5 * k) % 4) for k in range(n)] for i in range(rows)]


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("ordered", [True, False])
def test_short_and_long_lists_of_spans_agree_with_brute_force(spark, monkeypatch, few, ordered):
    monkeypatch.setattr(S, "FEW", few)
    lists = [(a, b) for n, m in ((1, 1), (1, 4), (3, 1), (4, 5)) for a, b in zip(spans_of(9, n), reversed(spans_of(9, m)))]
    df = spark.createDataFrame(lists, f"a {S.SPANS}, b {S.SPANS}")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", S.near(a, b, 4, ordered, 2).alias("near"), S.free_of(a, b).alias("free"), S.around(a, b).alias("around"), S.merge(b).alias("merged")).collect()
    plain = lambda spans: [tuple(s) for s in spans]
    for r in got:
        x, y = plain(r["a"]), plain(r["b"])
        close = lambda s, t: 2 <= t[0] - s[1] <= 4 or not ordered and 2 <= s[0] - t[1] <= 4
        assert plain(r["near"]) == sorted({(min(s[0], t[0]), max(s[1], t[1])) for s in x for t in y if close(s, t)})
        assert plain(r["free"]) == [s for s in x if not any(s[0] <= t[1] and s[1] >= t[0] for t in y)]
        assert plain(r["around"]) == [s for s in x if any(s[0] <= t[0] and t[1] <= s[1] for t in y)]
        held = sorted({p for s in y for p in range(s[0], s[1] + 1)})
        assert [p for s in plain(r["merged"]) for p in range(s[0], s[1] + 1)] == held
        assert all(s[1] + 1 < t[0] for s, t in zip(plain(r["merged"]), plain(r["merged"])[1:]))


@pytest.mark.parametrize("name", ["s_merge", "s_or", "s_near_chain", "s_not", "s_contains"])
def test_spans_meet_in_windows_in_as_many_tasks_as_hits_need(spark, tables, monkeypatch, name):
    monkeypatch.setattr(C, "TASK_HITS", 1)
    found = plan(R.QUERIES[name](spark, tables))
    assert "ObjectHashAggregate" not in found and "REPARTITION_BY_COL" not in found
    assert not [x for x in found.split("\n") if "Exchange hashpartitioning" in x and "query_id" in x and "doc_id" in x]


def test_union_of_spans_adds_scores_and_joins_lists_of_repeated_ids(spark):
    kind = f"query_id long, doc_id long, score double, spans {S.SPANS}"
    a = spark.createDataFrame([(1, 4, 1.0, [(0, 0)]), (1, 4, 2.0, [(5, 5)]), (None, 4, 1.0, [(1, 1)]), (1, 5, 1.0, [(0, 0), (1, 1)])], kind)
    b = spark.createDataFrame([(1, 4, 4.0, [(6, 6), (1, 2)]), (None, 4, 1.0, [(3, 3)])], kind)
    out = {(r["query_id"], r["doc_id"]): (r["score"], [tuple(s) for s in r["spans"]]) for r in P.s_or(a, b).collect()}
    assert out == {(1, 4): (7.0, [(0, 2), (5, 6)]), (None, 4): (2.0, [(1, 1), (3, 3)]), (1, 5): (1.0, [(0, 1)])}



@pytest.mark.parametrize("name", ["q_wildcard_end", "q_regex_end", "q_wildcard", "q_prefix", "q_wildcard_second"])
def test_hits_of_patterns_are_shuffled_once_by_document(spark, tables, monkeypatch, name):
    wide = R.QUERIES[name](spark, tables)
    rows = sorted(((r["query_id"], r["doc_id"]) for r in wide.collect()), key=str)
    assert len(set(rows)) == len(rows) > 0
    # Expansions too many to send to every task.
    measured = C.measured
    monkeypatch.setattr(C, "measured", lambda *a, **k: (False, measured(*a, **k)[1]))
    monkeypatch.setattr(C, "TASK_HITS", 1)
    dealt = R.QUERIES[name](spark, tables)
    found = plan(dealt)
    assert sorted(((r["query_id"], r["doc_id"]) for r in dealt.collect()), key=str) == rows
    assert "REPARTITION_BY_NUM" in found
    assert not [x for x in found.split("\n") if "Exchange hashpartitioning" in x and "doc_id" in x and ("query_id" in x or "clause_id" in x)]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_rows_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffle_files(spark)
    rows = stored(spark.range(1000).selectExpr("id % 7 AS k", "id").repartitionByRange(3, "k"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) - before == set()
    assert rows.count() == 1000 and spark.conf.get(key) == setting
