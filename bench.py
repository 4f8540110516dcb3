"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON."""

import importlib.util
import json
import os
import time

from groundspark.plans import registry
from groundspark.session import local_session

HEADLINE = [
    "flagship", "b1_clean_html", "b6_chunk_documents", "c1_hash_embedding", "c7_knn", "c8_approx_knn", "d1_postings", "d5_cover_density",
    "e3_hybrid_search", "f1_content_tokens", "g5_grounding_overlap", "g10_finalize_citations", "g12_decide", "h2_replace_docs", "h7_ingest_summary",
    "i2_gaps", "i5_cache_hits", "i7_quarantine", "i8_candidate_state", "j1_follow_ups", "k1_grade", "k7_quality_flags",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    queries = {n: registry.QUERIES[n] for n in HEADLINE}
    if importlib.util.find_spec("groundspark.llm") is not None:
        from groundspark.llm import queries as llm

        queries |= llm.QUERIES
    times = {}
    for name, query in queries.items():
        began = time.perf_counter()
        try:
            query(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        except Exception as e:  # noqa: BLE001 - one query's failure is reported, the others are timed
            times[name] = None
            print(f"{name}: {type(e).__name__}: {str(e)[:200]}", flush=True)
        spark.catalog.clearCache()
    done = [t for t in times.values() if t is not None]
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(done), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
