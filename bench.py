"""Headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The index is built once (``build_postings``) and read by the others, as a deployment would do. Where the folder ``sf0.01`` lies beside
the one that is timed, ``scaling`` tells how many times longer each job takes than over that; it runs first and warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffle by all stages so far; -1 if the session does not tell."""
    try:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
    except Exception:
        return -1


HEADLINES = ("top_k", "score_bm25", "s_phrase", "facets_many", "key_terms_bo1", "more_like", "near_duplicates", "page_tag_match", "tag_documents",
             "suggest", "an_standard", "term_stats", "collapse", "upsert", "sliding_clusters")


def main() -> None:
    from checks import registry
    from checks.base import index
    from gleanery.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of any job

    def run(folder: str) -> tuple[dict[str, float], dict[str, int]]:
        seconds: dict[str, float] = {}
        shuffled: dict[str, int] = {}
        jobs = {"build_postings": lambda: index(spark, folder)} | {name: lambda name=name: registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save() for name in HEADLINES}
        for name, job in jobs.items():
            before, start = shuffle_bytes(spark), time.time()
            job()
            seconds[name] = round(time.time() - start, 3)
            shuffled[name] = shuffle_bytes(spark) - before
        return seconds, shuffled

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    least = run(small)[0] if os.path.isdir(small) and os.path.abspath(small) != os.path.abspath(sf_dir) else {}
    seconds, shuffled = run(sf_dir)
    scaling = {name: round(seconds[name] / max(least[name], 0.001), 2) for name in least}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "shuffle_bytes": shuffled, "scaling": scaling}))
    spark.stop()


if __name__ == "__main__":
    main()
