"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of parquet tables, ``BENCH_CPUS`` the cores. Queries below ``REPEATED``
seconds run three times, and their median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanframe.checks.registry import QUERIES  # noqa: E402
from loanframe.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "period_rollup", "rule_profiles", "statement_features", "account_year_features",
    "running_balance", "last3_share_map", "zscore_vectors", "cohort_topk", "cohort_sentence",
    "align_union", "clean_applications", "median_fill", "balanced_sample", "stratified_split",
    "validate_applications", "loan_text", "tfidf_terms", "feature_matrix", "case_topk",
    "case_topk_cells", "case_batches", "loan_batches", "case_text_vectors", "precedent_summary",
    "token_ledger", "parse_responses", "normalise_markdown", "route_step", "citation_check",
    "decision_fields", "report_facts", "request_table", "installment_schedule",
    "monthly_card_bill",
]
REPEATED = 3.0


def timed(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One query ahead of the clock starts the JVM's compilers and the Python workers.
    QUERIES["parse_responses"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:]
    seconds = {}
    for name in only or HEADLINE:
        runs = [timed(spark, name)]
        while runs[0] < REPEATED and len(runs) < 3:
            runs.append(timed(spark, name))
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
