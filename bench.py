"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is run to completion with the ``noop`` sink (everything is
computed, nothing is collected to the driver).  ``value`` is the sum.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusflow.queries import QUERIES  # noqa: E402
from corpusflow.session import local_session  # noqa: E402

HEADLINE = [
    "passes_filter",       # F9: clean + gates
    "near_dup_pairs",      # J3/D2: exact similarity join
    "dedup_reference",     # D3: first-wins dedup
    "chat_messages",       # R1-R3, J5, P5: formatting
    "split_exact",         # L2/L3 over the deduplicated examples
    "split_filtered",      # L2/L3 without the dedup
    "collect_items",       # E2
    "synthetic_examples",  # E3
    "corpus_build",        # E1 end to end
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    # warm-up: JVM, parquet footers, codegen caches
    QUERIES["passes_filter"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
