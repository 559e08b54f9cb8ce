"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Every query runs
once to warm up and once for the clock; all result rows are computed (noop sink). ``--all`` times
every registered query instead.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerscan import build_session  # noqa: E402

HEADLINE = [
    "coerce_number_text",
    "coerce_date_text",
    "filter_regex",
    "filter_duplicate",
    "filter_top_n",
    "check_account_codes",
    "check_benford",
    "check_chain_or",
    "check_debit_credit_imbalance",
    "check_duplicates_second",
    "check_duplicate_documents",
    "check_journal_risk",
    "check_single_leg_voucher",
    "check_split_transaction",
    "groupby_all_aggregates",
    "groupby_quantiles",
    "join_two_keys",
    "join_group_totals_back",
    "fx_trigonometry",
    "fx_rank_eq_partitioned",
    "fx_rolling_mean_partitioned",
    "fx_cumsum_partitioned",
    "profile_text_lineitem",
    "profile_numeric_lineitem",
    "scan_user_activity",
    "scan_keywords_whole_word",
    "scan_unusual_accounts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "ledgerscan-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    import catalogue

    names = list(catalogue.QUERIES) if "--all" in sys.argv else HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
