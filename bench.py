"""Time the headline queries on the tables in $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is built and run to a sink that discards its rows, three times; the first run warms
up and the better of the other two counts. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helixframe.plans import catalog  # noqa: E402
from helixframe.session import build_session  # noqa: E402

HEADLINE = (
    "expand_alt_alleles",
    "calls_per_genotype",
    "condense",
    "range_count",
    "gene_counts",
    "variant_allele_join",
    "variant_sample_join",
    "exists_subquery",
    "holdout_anti",
    "merge_upsert",
    "write_clustered",
    "cumulative_weight",
    "nearest_bucket",
    "gen_row",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, times = catalog.queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(min(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline queries, best warm run, sum",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
