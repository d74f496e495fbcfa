"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated, or ``all``) choose the data,
the cores and the queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_anomalies",
    "s1_scan_log_lines",
    "s2_log_format_profile",
    "s11_append_records",
    "p1_json_lines",
    "p2_combined_lines",
    "p3_log_lines",
    "p7_light_json_or_quoted",
    "p11_query_params",
    "p15_parse_requests",
    "n4_mask_values",
    "n5_training_text",
    "t1_tokenize",
    "t2_vocabulary",
    "t4_encode",
    "m1_fit_unigram",
    "m1_fit_bigram",
    "m2_score_unigram",
    "m2_score_bigram",
    "m6_score_batch",
    "m11_merge_counts",
    "m12_model_store",
    "d1_build_records",
    "d2_filter_history",
    "d4_recent_page",
    "d6_replay",
    "d8_cleanup",
    "d7_stats",
    "d10_rate_audit",
    "d10_rate_bound",
    "e1_error_rates",
    "w4_detect_stream",
]

# Input table of the queries whose rate is reported.
RATES = {"p3_log_lines": "events", "t1_tokenize": "documents", "m6_score_batch": "pages"}


def main() -> None:
    from reqsieve.plans.queries import QUERIES
    from reqsieve.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    # JVM and code generation warm up outside the clock.
    QUERIES["p3_log_lines"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        # Every column of every row is computed; a count would let Spark skip most of it.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rates = {
        n: round(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() / times[n], 1)
        for n, t in RATES.items()
        if n in times
    }
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
