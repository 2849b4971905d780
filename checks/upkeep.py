"""Table maintenance and streams (streams run to completion over the given tables)."""

from pyspark.sql import functions as F

from gleanery.functions import tokens as T
from gleanery.operators import maintain as Mt
from gleanery.operators.index import text_field
from gleanery.session import scratch_path
from gleanery.streaming import ChangeTable, SeenTable, StatisticsTable, stream_buffered_commit, stream_new_urls, stream_tag, stream_tail, stream_term_stats, stream_upsert_delete

from .base import POSTINGS, check, index, table
from .matching import PAGE_URL, TAGS, dictionary

# Changes to the orders come from the events: user u changes order u, the event number is the arrival order.
NEW = "up AS (SELECT user_id AS k, event_type AS status, value AS price, event_id AS seq FROM events)"


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def updates(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("status"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders)"
LAST = "la AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"


@check("upsert", f"WITH {NEW}, {OLD}, {LAST} SELECT k, status, price FROM old ANTI JOIN la USING (k) UNION ALL SELECT k, status, price FROM la")
def upsert(spark, sf):
    return Mt.upsert(orders(spark, sf), updates(spark, sf), "k", "seq")


@check("delete_by_term", f"WITH {OLD} SELECT * FROM old WHERE status <> 'F'")
def delete_by_term(spark, sf):
    return Mt.delete_by_term(orders(spark, sf), "status", "F")


@check("delete_by_query", f"WITH {NEW}, {OLD} SELECT * FROM old WHERE k NOT IN (SELECT k FROM up WHERE status = 'error')")
def delete_by_query(spark, sf):
    return Mt.delete_by_query(orders(spark, sf), updates(spark, sf).filter("status = 'error'").select("k"), "k")


@check("deleted_count", "SELECT count(*) AS deleted FROM orders WHERE o_orderstatus = 'F'")
def deleted_count(spark, sf):
    o = orders(spark, sf)
    return Mt.deleted_count(o, Mt.delete_by_term(o, "status", "F"))


@check("update_fields", f"WITH {OLD} SELECT k, CASE WHEN status = 'P' THEN 'X' ELSE status END AS status, CASE WHEN status = 'P' THEN 0.0 ELSE price END AS price FROM old")
def update_fields(spark, sf):
    return Mt.update_fields(orders(spark, sf), {"status": "P"}, {"status": "X", "price": 0.0})


@check("update_fields_first", f"WITH {OLD} SELECT k, CASE WHEN k = (SELECT min(k) FROM old WHERE status = 'P') THEN 'X' ELSE status END AS status, price FROM old")
def update_fields_first(spark, sf):
    return Mt.update_fields(orders(spark, sf), {"status": "P"}, {"status": "X"}, multi=False, key="k")


@check("insert_unique", f"WITH {OLD}, nw AS (SELECT o_orderkey * 3 AS k, 'N' AS status, 1.0::DOUBLE AS price FROM orders) SELECT * FROM old UNION ALL SELECT * FROM nw WHERE k NOT IN (SELECT k FROM old)")
def insert_unique(spark, sf):
    o = orders(spark, sf)
    return Mt.insert_unique(o, o.select((F.col("k") * 3).alias("k"), F.lit("N").alias("status"), F.lit(1.0).alias("price")), "k")


@check("find", f"WITH {OLD} SELECT k, price FROM old WHERE status = 'O' ORDER BY price DESC, k LIMIT 25 OFFSET 10")
def find(spark, sf):
    return Mt.find(orders(spark, sf), {"status": "O"}, ["k", "price"], [("price", -1), ("k", 1)], 10, 25)


@check("find_one", f"WITH {OLD} SELECT k FROM old WHERE status = 'O' ORDER BY price, k LIMIT 1")
def find_one(spark, sf):
    return Mt.find_one(orders(spark, sf), {"status": "O"}, ["k"], [("price", 1), ("k", 1)])


@check("count_rows", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_rows(spark, sf):
    return Mt.count_rows(orders(spark, sf), {"status": "O"})


@check("distinct_values", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part")
def distinct_values(spark, sf):
    return Mt.distinct_values(table(spark, sf, "part").withColumn("words", F.split("p_name", " ")), "words")


@check("group_reduce", f"WITH {OLD} SELECT status, count(*) AS n, round(sum(price), 2) AS total, round(round(sum(price), 2) / count(*), 2) AS mean FROM old WHERE price > 1000 GROUP BY status")
def group_reduce(spark, sf):
    return Mt.group_reduce(orders(spark, sf), ["status"], [F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")], F.col("price") > 1000, {"mean": F.round(F.col("total") / F.col("n"), 2)})


@check("find_and_modify", f"WITH {OLD}, f AS (SELECT k FROM old WHERE status = 'O' ORDER BY price DESC, k LIMIT 1) SELECT 'after' AS image, k, CASE WHEN k IN (SELECT k FROM f) THEN 'Z' ELSE status END AS status FROM old "
       "UNION ALL SELECT 'old', k, status FROM old WHERE k IN (SELECT k FROM f) UNION ALL SELECT 'new', k, 'Z' FROM f")
def find_and_modify(spark, sf):
    images = Mt.find_and_modify(orders(spark, sf), {"status": "O"}, {"status": "Z"}, [("price", -1)], "k")
    out = None
    for name, df in zip(("after", "old", "new"), images, strict=True):
        rows = df.select(F.lit(name).alias("image"), "k", "status")
        out = rows if out is None else out.union(rows)
    return out


# ---- streams
CHANGES = "ch AS (SELECT user_id AS k, event_type AS status, value AS price, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS seq FROM events)"


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@check("stream_upsert_delete", f"WITH {CHANGES} SELECT k, status, price FROM ch QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1 AND op <> 'delete'")
def stream_upsert_delete_query(spark, sf):
    source = scratch_path(spark, "changes")
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    rows = e.select(F.col("user_id").alias("k"), F.col("event_type").alias("status"), F.col("value").alias("price"), op.alias("op"), F.col("event_id").alias("seq"))
    # Several batches in no order of arrival: the newest change of a key may come in an early one.
    rows.repartition(4, "price").write.parquet(source)
    schema = "k long, status string, price double, op string, seq long"
    target = ChangeTable(spark, scratch_path(spark, "table"), "k", "k long, status string, price double")
    run(stream_upsert_delete(stream_tail(spark, source, schema, files_per_batch=1), target, scratch_path(spark, "cp")))
    target.compact()
    return target.current()


@check("stream_buffered_commit", f"WITH {CHANGES} SELECT k, max(seq) AS seq FROM ch GROUP BY k")
def stream_buffered_commit_query(spark, sf):
    source, out = scratch_path(spark, "changes"), scratch_path(spark, "commits")
    table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq")).repartitionByRange(4, "seq").write.parquet(source)

    def commit(batch, epoch):
        Mt.last_per_key(batch, "k", ["seq"]).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    run(stream_buffered_commit(stream_tail(spark, source, "k long, seq long", files_per_batch=1), commit, scratch_path(spark, "cp"), period=None))
    return Mt.last_per_key(spark.read.parquet(out).select("k", "seq"), "k", ["seq"])


@check("stream_tag", TAGS + " SELECT doc_id AS id, coalesce(md5(string_agg(term, '|' ORDER BY pos)), md5('')) AS tags FROM documents LEFT JOIN tg ON id = doc_id GROUP BY doc_id")
def stream_tag_query(spark, sf):
    source = scratch_path(spark, "arriving")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("upsert").alias("op"), F.col("doc_id").alias("seq"))
    docs.repartitionByRange(3, "seq").write.parquet(source)
    target = ChangeTable(spark, scratch_path(spark, "tagged"), "id", "id long, tags array<string>")
    feed = stream_tail(spark, source, "id long, text string, op string, seq long")
    run(stream_tag(feed, dictionary(spark, sf), target, scratch_path(spark, "cp")))
    return target.current().select("id", F.md5(F.array_join("tags", "|")).alias("tags"))


@check("stream_new_urls", f"WITH ca AS (SELECT page_id, nullif(regexp_extract(url, '{PAGE_URL}', 1), '') AS curl FROM pages) SELECT DISTINCT curl AS url FROM ca WHERE curl IS NOT NULL AND curl NOT IN (SELECT curl FROM ca WHERE page_id % 2 = 0 AND curl IS NOT NULL)")
def stream_new_urls_query(spark, sf):
    from gleanery.plans.service import canonical_url
    source = scratch_path(spark, "visits")
    pages = table(spark, sf, "pages")
    # Several batches, in which addresses come again, and come first in rows that are days late.
    late = F.timestamp_seconds(F.col("page_id") * 86_400 * F.when(F.col("page_id") % 3 == 0, -1).otherwise(1))
    visits = pages.select("url", late.alias("ts")).unionByName(pages.select("url", F.timestamp_seconds(F.col("page_id")).alias("ts")))
    visits.repartition(4, "ts").write.parquet(source)
    known = pages.filter("page_id % 2 = 0").select(canonical_url(pattern=PAGE_URL).alias("url")).filter("url IS NOT NULL").distinct()
    seen = SeenTable(spark, scratch_path(spark, "new"), "url")
    run(stream_new_urls(stream_tail(spark, source, "url string, ts timestamp", files_per_batch=1), known, seen, scratch_path(spark, "cp"), PAGE_URL))
    return seen.current()


@check("stream_tail", "SELECT event_id, user_id FROM events")
def stream_tail_query(spark, sf):
    source, out = scratch_path(spark, "tail"), scratch_path(spark, "copy")
    table(spark, sf, "events").select("event_id", "user_id").repartitionByRange(3, "event_id").write.parquet(source)
    feed = stream_tail(spark, source, "event_id long, user_id long", files_per_batch=1)
    run(feed.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start(out))
    return spark.read.parquet(out)


@check("stream_term_stats", f"WITH {POSTINGS} SELECT term, df, cf FROM ts")
def stream_term_stats_query(spark, sf):
    source = scratch_path(spark, "arriving")
    table(spark, sf, "documents").select("doc_id", "text").repartitionByRange(3, "doc_id").write.parquet(source)
    stats = StatisticsTable(spark, scratch_path(spark, "stats"), (text_field("text"),))
    run(stream_term_stats(stream_tail(spark, source, "doc_id long, text string", files_per_batch=1), stats, scratch_path(spark, "cp")))
    return stats.current().select("term", "df", "cf")
