"""Tables kept by streams: bounded runs, replays, late changes, forgotten deletes, keyed state."""

import random

from pyspark.sql import functions as F

from gleanery.operators.index import text_field
from gleanery.streaming import ChangeTable, SeenTable, StatisticsTable, stream_new_urls, stream_tail

CHANGE = "k long, v string, op string, seq long"


def _plain(batches):
    best = {}
    for epoch, rows in enumerate(batches):
        for k, v, op, seq in rows:
            if k not in best or (seq, epoch) >= best[k][0]:
                best[k] = ((seq, epoch), v, op)
    return {k: v for k, (_, v, op) in best.items() if op != "delete"}


def _batches(n, seed=5):
    rng, seq, out = random.Random(seed), list(range(n * 6)), []
    rng.shuffle(seq)
    for b in range(n):
        out.append([(rng.randrange(9), f"v{s}", rng.choice(["upsert", "upsert", "delete"]), s) for s in seq[b * 6:b * 6 + 6]])
    return out


def _apply(spark, table, batches, start=0):
    for epoch, rows in enumerate(batches, start):
        table.apply(spark.createDataFrame(rows, CHANGE).coalesce(1), epoch)


def _rows(table):
    return {r.k: r.v for r in table.current().collect()}


def test_runs_stay_few_and_rows_stay_right(spark, tmp_path):
    batches = _batches(19)
    table = ChangeTable(spark, str(tmp_path / "t"), "k", "k long, v string", fan_in=2, keep=2)
    for epoch in range(len(batches)):
        _apply(spark, table, batches[epoch:epoch + 1], epoch)
        live = table.runs.live()
        assert live[0][0] == 0 and live[-1][1] == epoch
        assert all(a[1] + 1 == b[0] for a, b in zip(live, live[1:]))
        assert len(live) <= (epoch + 1).bit_length()
        assert len(table.runs.complete()) <= 2 * (epoch + 1).bit_length() + 2 * table.keep
    assert _rows(table) == _plain(batches)
    table.compact()
    assert table.runs.live() == [(0, 18)]
    assert _rows(table) == _plain(batches)
    _apply(spark, table, [[(3, "late", "upsert", -1), (4, "new", "upsert", 10_000)]], 19)
    assert _rows(table) == _plain(batches + [[(3, "late", "upsert", -1), (4, "new", "upsert", 10_000)]])


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    batches = _batches(9)
    table = ChangeTable(spark, str(tmp_path / "t"), "k", "k long, v string", fan_in=2)
    _apply(spark, table, batches[:8])
    before = _rows(table)
    _apply(spark, table, batches[7:8], 7)
    assert _rows(table) == before == _plain(batches[:8])
    # A fold that failed half way has no marker and is not read.
    half = tmp_path / "t" / "run=0-99"
    half.mkdir()
    _apply(spark, table, batches[8:], 8)
    assert _rows(table) == _plain(batches)


def test_old_deletes_are_forgotten_only_behind_the_horizon(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), "k", "k long, v string", horizon=10)
    _apply(spark, table, [[(1, "a", "delete", 1), (2, "b", "delete", 95), (3, "c", "upsert", 2)], [(4, "d", "upsert", 100)]])
    table.compact()
    kept = {r.k for r in table.changes().collect()}
    assert kept == {2, 3, 4}
    _apply(spark, table, [[(2, "late", "upsert", 94)]], 2)
    assert _rows(table) == {3: "c", 4: "d"}


def test_empty_tables(spark, tmp_path):
    changes = ChangeTable(spark, str(tmp_path / "c"), "k", "k long, v string")
    assert _rows(changes) == {}
    _apply(spark, changes, [[]])
    assert _rows(changes) == {}
    changes.compact()
    assert SeenTable(spark, str(tmp_path / "s"), "url").current().count() == 0
    assert StatisticsTable(spark, str(tmp_path / "f"), (text_field("text"),)).current().count() == 0


def test_statistics_add_up_over_folds(spark, tmp_path):
    table = StatisticsTable(spark, str(tmp_path / "f"), (text_field("text"),), fan_in=2, keep=1)
    texts = ["apple pear", "apple apple", "plum", "pear plum apple", "plum"]
    for epoch, text in enumerate(texts):
        table.apply(spark.createDataFrame([(epoch, text)], "doc_id long, text string"), epoch)
    got = {r.term: (r.df, r.cf) for r in table.current().collect()}
    assert got == {"apple": (3, 4.0), "pear": (2, 2.0), "plum": (3, 3.0)}


def test_an_address_is_new_once_across_restarts(spark, tmp_path):
    source, checkpoint = str(tmp_path / "visits"), str(tmp_path / "cp")
    known = spark.createDataFrame([("h/2",)], "url string")
    seen = SeenTable(spark, str(tmp_path / "seen"), "url")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def arrive(*urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(source)
        query = stream_new_urls(stream_tail(spark, source, "url string", files_per_batch=1), known, seen, checkpoint, "^(h/[0-9]+)")
        query.awaitTermination()
        assert query.exception() is None

    arrive("h/1?a", "h/1?b", "h/2", None, "other")
    arrive("h/1", "h/3")
    arrive("h/3", "h/2", "h/1")
    assert sorted(r.url for r in seen.current().collect()) == ["h/1", "h/3"]
    sizes = [seen.runs.read([r]).agg(F.count("url")).first()[0] for r in seen.runs.complete()]
    assert sizes == [1, 1, 0]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
