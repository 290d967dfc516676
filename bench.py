"""Times the headline jobs and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every job runs
once to warm up and then BENCH_RUNS times (default 3); the median counts. A job's
inputs are the written tables of the layer below it, as in a nightly run; its
result is written in full to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.operators import linkage, lookup, profile, reports  # noqa: E402
from riskloom.plans.inputs import Inputs  # noqa: E402
from riskloom.plans.oracle import AS_OF  # noqa: E402
from riskloom.session import local_session  # noqa: E402

JOBS = {
    "silver_inspections": lambda i: i.build_osha(),
    "silver_wages": lambda i: i.build_whd(),
    "silver_mine_violations": lambda i: i.build_msha(),
    "employer_keys": lambda i: profile.employer_keys(i.osha, i.whd),
    "employer_profile": lambda i: i.build_profile(AS_OF),
    "serving_rows": lambda i: i.build_served(AS_OF),
    "fuzzy_search": lambda i: lookup.search_by_name(i.served, "COLD WIDGT FURNITURE", index=i.name_index),
    "bulk_enrichment": lambda i: lookup.enrich_lookups(i.raw("lookups"), i.served),
    "parent_rollups": lambda i: lookup.parent_rollups(i.served),
    "industry_benchmark": lambda i: reports.industry_benchmark(i.served),
    "candidate_pairs": lambda i: linkage.candidate_pair_counts(i.records),
    "scored_pairs": lambda i: linkage.scored_pairs(i.records),
    "clusters": lambda i: linkage.cluster_records(i.records),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = [job for job in os.environ.get("BENCH_JOBS", "").split(",") if job] or list(JOBS)
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(spark, sf_dir)
    rows = {"inspections": inputs.osha.count(), "profiles": inputs.served.count(), "lookups": inputs.raw("lookups").count()}
    seconds = {}
    for job in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            JOBS[job](inputs).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[job] = round(statistics.median(times[1:]), 3)
        print(job, seconds[job], file=sys.stderr, flush=True)
    line = {
        "metric": "total of median job times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "rows": rows,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
